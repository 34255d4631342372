"""Exact dense top-k: a matrix product a batch of vectors, and the best of each partition before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.vectors import normalised
from paperloom.operators.lexical import ranked
from paperloom.shared import bounded_batches

#: Least cosine of a hit; queries that go to the workers at once (a bound on what is sent: this many vectors); vectors
#: that meet a block of queries in one task where there are more queries than that; scores of one product, which a worker
#: holds at once.
FLOOR, QUERY_BLOCK, VECTOR_BLOCK, PRODUCT = 0.25, 2048, 16384, 1 << 19
SCORES = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def add_vectors(index: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Append chunk_id, embedding rows at unit length; those without a vector or of another length are left out."""
    fits = new.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim))
    return index.unionByName(fits.select("chunk_id", normalised("embedding").alias("embedding")))


def _unit(rows: list) -> np.ndarray:
    x = np.array([r for r in rows], np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _usable(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length without a null, and these vectors, from the batch's own buffer."""
    off, null = vectors.offsets.to_numpy(), vectors.is_null().to_numpy(zero_copy_only=False)
    missing = np.concatenate([[0], np.cumsum(vectors.values.is_null().to_numpy(zero_copy_only=False))])
    good = np.flatnonzero(~null & (np.diff(off) == dim) & (missing[off[1:]] == missing[off[:-1]]))
    x = vectors.values.to_numpy(zero_copy_only=False)
    return good, x[off[good][:, None] + np.arange(dim)].astype(np.float64)


def _best(ids: list[int], queries: np.ndarray, n: int):
    """The n best of each query among a task's vectors. PRODUCT scores are made at a time; of those only what reaches a query's
    n-th best so far is looked at again."""
    size = max(1, PRODUCT // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(ids), -np.inf)
        owner, score, chunk = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for b in (whole.slice(lo, size) for whole in batches for lo in range(0, whole.num_rows, size)):
            good, x = _usable(b.column("embedding"), queries.shape[1])
            if not len(good):
                continue
            new = np.round(queries @ _unit(x).T, 9)
            q, v = np.nonzero(new >= least[:, None])
            if not len(q):
                continue
            owner, score = np.concatenate([owner, q]), np.concatenate([score, new[q, v]])
            chunk = np.concatenate([chunk, b.column("chunk_id").to_numpy()[good][v]])
            order = np.lexsort((chunk, -score, owner))
            owner, score, chunk = owner[order], score[order], chunk[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            last = place == n - 1
            least[owner[last]] = score[last]
            owner, score, chunk = owner[place < n], score[place < n], chunk[place < n]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[owner]), pa.array(chunk), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run


def _cell(n: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        # a pair of blocks may lack one of both sides
        if not vectors.num_rows or not queries.num_rows:
            return SCORES.empty_table()
        best = _best(queries.column("query_id").to_pylist(), _unit(queries.column("embedding").to_pylist()), n)
        rows = vectors.select(["chunk_id", "embedding"]).combine_chunks()
        return pa.Table.from_batches(best(iter(rows.to_batches())), SCORES)

    return run


def _grid(vectors: DataFrame, queries: DataFrame, n: int, block: int, vector_block: int) -> DataFrame:
    """Blocks of vectors against blocks of queries, each pair of blocks in a group of bounded size."""
    q, v = (max(1, -(-rows.count() // size)) for rows, size in ((queries, block), (vectors, vector_block)))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = vectors.select("chunk_id", "embedding", F.pmod(F.xxhash64("chunk_id", "embedding"), F.lit(v)).alias("v"), every(q).alias("q"))
    right = queries.select("query_id", "embedding", every(v).alias("v"), F.pmod(F.xxhash64("query_id", "embedding"), F.lit(q)).alias("q"))
    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_cell(n), "query_id long, chunk_id long, score double")


def dense_scores(vectors: DataFrame, queries: DataFrame, n: int, block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """Per query at least its n best: query_id, chunk_id, score. queries: query_id, embedding; a stated set. Up to a
    block of them goes to the workers as it is; more meet the vectors in a shuffle, block by block, so that neither the
    plan nor the driver grows with them."""
    vectors, asked = vectors.select("chunk_id", "embedding"), queries.filter("embedding is not null").select("query_id", "embedding")
    bounded_batches(vectors.sparkSession)
    rows = asked.limit(block + 1).collect()
    if len(rows) > block:
        return _grid(vectors, asked, n, block, vector_block)
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double")
    return vectors.mapInArrow(_best([r[0] for r in rows], _unit([r[1] for r in rows]), n), "query_id long, chunk_id long, score double")


def dense_topk(vectors: DataFrame, queries: DataFrame, n: int, floor: float = FLOOR) -> DataFrame:
    """The n best of each query that reach the floor: query_id, rank0, chunk_id, score."""
    return ranked(dense_scores(vectors, queries, n), n, least=floor).select("query_id", "rank0", "chunk_id", "score")
