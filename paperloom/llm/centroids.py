"""Centroid clustering by partial-distance search, in whole numbers.

A batch of vectors first sums squared differences to all centroids over a few dimensions, those of the highest variance.
The nearest by that part is measured in full: its distance is the bound. The other centroids go on in blocks of
dimensions, and one is abandoned for a vector as soon as its partial distance is strictly above the vector's bound. Those that
stay finish all dimensions; the least distance wins, the smaller number among equal ones. A partial sum never falls, so
nothing that could win, or tie, is abandoned.

A round is one pass: each partition gives the sums and counts of its clusters, which meet in a tree on the executors. The
driver sees one (clusters x dimensions) matrix a round, whatever the number of vectors is, and however many of them fall
into one cluster.

Nulls and edge cases: only vectors of exactly `dim` components, none of them null or not finite, are kept; others give
no row. Repeated vec_ids are each a vector; ties of a start's hash go by the vector; a null vec_id hashes as `1`. With
fewer vectors than clusters there are as many centroids as vectors; an empty table gives no rows. Components whose
64-fold is beyond 2**27 count as that, so that a distance is a long; an inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, release, written
from paperloom.llm.grid import floors, is_finite, matrix, tree_merged

CLUSTERS, ROUNDS, DIM, MOST = 16, 3, 64, 1 << 27
#: Dimensions of a block of partial distances.
BLOCK = 8


def kept(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, x: the vectors that count, as whole numbers."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dim) & is_finite("embedding"))
    return whole.select("vec_id", floors("embedding", MOST).alias("x"))


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the least sha256 of `1:<vec_id>`, in that order."""
    rows = vectors.withColumn("hash", F.sha2(F.concat_ws(":", F.lit("1"), F.col("vec_id").cast("string")), 256)).orderBy("hash", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each vector, and how many squared differences were
    summed for it. order: dimensions, those that say most first."""
    x, c = x[:, order], centroids[:, order]
    part = np.square(x[:, None, :block] - c[None, :, :block]).sum(axis=2)
    bound = np.square(x - c[part.argmin(axis=1)]).sum(axis=1)
    row, number = np.nonzero(part <= bound[:, None])
    so_far, done = part[row, number], part.size * min(block, x.shape[1]) + x.size
    for lo in range(block, x.shape[1], block):
        so_far = so_far + np.square(x[row, lo : lo + block] - c[number, lo : lo + block]).sum(axis=1)
        done += len(row) * min(block, x.shape[1] - lo)
        on = so_far <= bound[row]
        row, number, so_far = row[on], number[on], so_far[on]
    first = np.lexsort((number, so_far, row))
    row, at = np.unique(row[first], return_index=True)
    return number[first][at], so_far[first][at], done


def _sums(f):
    """One row a partition: the sum of what f makes of its batches, an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = None
        for b in batches:
            if b.num_rows:
                got = f(matrix(b.column("x")))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _total(vectors: DataFrame, f) -> np.ndarray | None:
    return tree_merged(vectors.mapInArrow(_sums(f), "sums binary"), lambda r: np.frombuffer(r[0], np.int64), np.add)


def by_variance(vectors: DataFrame, origin: np.ndarray) -> np.ndarray:
    """The dimensions in order of falling variance; the order only saves work. Values are taken from an origin and cut to
    2**15, so that no sum leaves a long."""

    def f(x: np.ndarray) -> np.ndarray:
        y = np.clip(x - origin, -(1 << 15), 1 << 15)
        return np.concatenate([[len(y)], y.sum(axis=0), np.square(y).sum(axis=0)])

    got = _total(vectors, f)
    n, sums, squares = int(got[0]), got[1 : len(origin) + 1].astype(float), got[len(origin) + 1 :].astype(float)
    return np.argsort(-(squares / n - np.square(sums / n)), kind="stable")


def moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor of the exact mean; one without vectors stays."""
    k, dim = centroids.shape

    def f(x: np.ndarray) -> np.ndarray:
        number, _, _ = nearest(x, centroids, order)
        out = np.zeros((k, dim + 1), np.int64)
        np.add.at(out, number, np.hstack([x, np.ones((len(x), 1), np.int64)]))
        return out.ravel()

    got = _total(vectors, f).reshape(k, dim + 1)
    count = got[:, dim:]
    return np.where(count > 0, got[:, :dim] // np.maximum(count, 1), centroids)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """vectors: vec_id, x. The centroids after all rounds and the order of dimensions."""
    centroids = starts(vectors, k)
    if not len(centroids):
        return centroids, np.zeros(0, np.int64)
    order = by_variance(vectors, centroids[0])
    for _ in range(rounds):
        centroids = moved(vectors, centroids, order)
    return centroids, order


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            if b.num_rows:
                number, distance, _ = nearest(matrix(b.column("x")), centroids, order)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vectors: vec_id, embedding. vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = prepare(vectors.sparkSession)
    rows = written(kept(vectors, dim), "kept")
    centroids, order = fit(rows, k, rounds)
    out = written(assigned(rows, centroids, order), "assigned")
    discard(rows)
    sums = out.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    known = sums.join(F.broadcast(named), "cluster").withColumn("inertia", sums.agg(F.try_sum("cluster_inertia")).scalar())
    # a row a cluster
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
