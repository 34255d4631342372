"""Vector arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def blended(query: Column | str, passage: Column | str, share: float = 0.3) -> Column:
    """The query's vector with a share of a hypothetical passage's, of unit length."""
    return normalised(F.zip_with(col(query), col(passage), lambda q, p: (1 - share) * q.cast("double") + share * p.cast("double")))
