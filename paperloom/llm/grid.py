"""Vectors as integers: what whitening and clustering compute with, and sums that meet in a tree."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of one that a component is counted in.
SCALE = 64


def is_finite(vector: str) -> Column:
    """Whether a vector is there and all of its components are, and are finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, fine)


def floors(vector: str, most: int, plus: int = 0) -> Column:
    """floor(SCALE * c) + plus of each component c, as long. Those whose floor is beyond most, or below -most, count as
    that: sums and squares then stay whole numbers."""
    whole = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(most)), F.lit(-most)) + plus
    return F.transform(vector, whole)


def matrix(column: pa.Array) -> np.ndarray:
    """A batch's arrays, all of one length, as rows of a matrix; nulls don't occur."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def tree_merged(rows: DataFrame, read: Callable[[Any], Any], merge: Callable[[Any, Any], Any], depth: int = 2) -> Any:
    """What a few rows of each partition come to, merged in pairs up a tree on the executors; the driver gets the root.
    None where there is no row."""
    rdd = rows.rdd.mapPartitions(lambda some: [_fold(map(read, some), merge)])
    return rdd.treeReduce(lambda a, b: b if a is None else a if b is None else merge(a, b), depth) if rdd.getNumPartitions() else None


def _fold(items, merge):
    out = None
    for x in items:
        out = x if out is None else merge(out, x)
    return out
