"""Reciprocal-rank fusion, of two lists and of weighted query variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60


def _share(rank: str, weight: Column | float = 1.0) -> Column:
    return (F.lit(weight) if isinstance(weight, float) else weight) / (F.lit(float(K + 1)) + F.col(rank))


def hybrid(dense: DataFrame, lexical: DataFrame, n: int) -> DataFrame:
    """Full outer join of two ranked lists (query_id, rank0, chunk_id, score): query_id, rank0, chunk_id, distance,
    rrf_score. distance is 0 where only the lexical list has the chunk."""
    d = dense.select("query_id", "chunk_id", F.col("rank0").alias("dense_rank"), F.col("score").alias("distance"))
    x = lexical.select("query_id", "chunk_id", F.col("rank0").alias("lexical_rank"))
    both = d.join(x, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(_share("dense_rank"), F.lit(0.0)) + F.coalesce(_share("lexical_rank"), F.lit(0.0))
    scored = both.select("query_id", "chunk_id", F.coalesce("distance", F.lit(0.0)).alias("distance"), score.alias("rrf_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "chunk_id")
    return scored.withColumn("rank0", F.row_number().over(order) - 1).filter(F.col("rank0") < n).select("query_id", "rank0", "chunk_id", "distance", "rrf_score")


def fusion_key(by_chunk: bool = False) -> Column:
    """What counts as the same hit: the source and the first 50 characters, or the chunk."""
    return F.col("chunk_id").cast("string") if by_chunk else F.concat(F.coalesce("source", F.lit("")), F.substring("text", 1, 50))


def weighted(lists: DataFrame, n: int = 15, by_chunk: bool = False) -> DataFrame:
    """lists: query_id, list_seq, weight, rank0, source, text and any other columns of a hit. Per query the n best: the
    last writer's row with rrf_score; equal scores in the order in which their keys were first seen."""
    rest = [c for c in lists.columns if c not in ("query_id", "weight")]
    keyed = lists.withColumn("fusion_key", fusion_key(by_chunk))
    merged = keyed.groupBy("query_id", "fusion_key").agg(
        F.sum(_share("rank0", F.col("weight").cast("double"))).alias("rrf_score"),
        F.max_by(F.struct(*rest), F.struct("list_seq", "rank0")).alias("hit"),
        F.min(F.struct("list_seq", "rank0")).alias("first"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), "first")
    out = merged.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n)
    return out.select("query_id", "fusion_key", F.col("place").alias("rank0"), "rrf_score", *[F.col(f"hit.{c}").alias(c) for c in rest if c not in ("rank0", "rrf_score")])
