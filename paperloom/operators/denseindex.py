"""Exact dense top-k over an index: groups of vectors around centres, in blocks by their angle to the centre.

A block's vectors are all between two angles from its group's centre, so none of them is nearer to a question than the
question's own angle to the centre allows. The groups nearest to a question are multiplied first; its n-th best score
there is one that the n best reach. Any other block whose bound is below that isn't multiplied. Vectors are moved once, when
the index is built; a search reads blocks where they are, and no vector is copied for a block of questions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.dense import FLOOR, SCORES, _unit, _usable
from paperloom.operators.lexical import best, ranked
from paperloom.shared import written

#: Groups at most; vectors that centres are chosen from, for each; vectors of a block; groups that a question tries first;
#: questions of a pass.
GROUPS, SAMPLE, BLOCK, FIRST, QUESTIONS = 1024, 16, 1024, 4, 2048
#: Scores are compared as rounded at nine digits; angles have errors of this size.
SLACK = 1e-7
_ROWS = "group int, lo double, hi double, ids array<long>, vectors binary"


@dataclass
class DenseIndex:
    """blocks: group, lo, hi (least and greatest angle to the centre), ids, vectors (unit vectors as doubles, one after the other)."""

    blocks: DataFrame
    centres: np.ndarray


@dataclass
class DenseSearch:
    """scores (query_id, chunk_id, score) hold the n best of each question; work has products and all (one row)."""

    scores: DataFrame
    work: DataFrame


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def chosen_centres(sample: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """k directions among the sample's vectors: means of the nearest, a few times over; fewer where vectors repeat."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(1).permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.where(length > 1e-9, length, 1), centres)
    return centres


def build(vectors: DataFrame, dim: int, groups: int | None = None) -> DenseIndex:
    """vectors: chunk_id, embedding; those without a vector of this length, or with a null in it, are left out. Centres come
    from a bounded sample (SAMPLE vectors a group, those with the least hashes), so they only decide how much is skipped."""
    rows = vectors.select("chunk_id", "embedding").filter(F.size("embedding") == dim)
    n = rows.count()
    k = min(groups or GROUPS, max(1, int(n**0.5)))
    some = rows.filter(~F.exists("embedding", lambda x: x.isNull())).orderBy(F.xxhash64("chunk_id", "embedding")).limit(SAMPLE * k).select("embedding").collect()
    centres = chosen_centres(_unit([r[0] for r in some]), k) if some else np.zeros((0, dim))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, x = _usable(b.column("embedding"), dim)
            x = _unit(x) if len(good) else x
            angle = _angles(x, centres) if len(good) else np.zeros((0, 1))
            group = angle.argmin(axis=1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * dim), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(angle[np.arange(len(good)), group]), b.column("chunk_id").take(pa.array(good)), flat], ["group", "angle", "chunk_id", "unit"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # sorted by group and angle
            group, angle = b.column("group").to_numpy(), b.column("angle").to_numpy()
            x = b.column("unit").flatten().to_numpy().reshape(len(group), -1)
            edges = np.flatnonzero(np.diff(group)) + 1
            cuts = [c for lo, hi in zip([0, *edges], [*edges, len(group)]) for c in range(lo, hi, BLOCK)] + [len(group)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi > lo:
                    columns = [pa.array(group[lo : lo + 1]), pa.array(angle[lo : lo + 1]), pa.array(angle[hi - 1 : hi]), pa.array([b.column("chunk_id").to_pylist()[lo:hi]], pa.list_(pa.int64())), pa.array([x[lo:hi].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "lo", "hi", "ids", "vectors"])

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["group", "angle", "chunk_id"]  # so that a large group, and vectors that are equal, are spread
    moved = rows.mapInArrow(placed, "group int, angle double, chunk_id long, unit array<double>").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return DenseIndex(written(moved.mapInArrow(blocks, _ROWS), "dense-index"), centres)


class _Asked:
    """A pass's questions: for a block, those that can find something in it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centres: np.ndarray, reached: np.ndarray | None):
        self.ids, self.x, self.angle, self.reached = ids, x, _angles(x, centres), reached
        self.first = np.argsort(self.angle, axis=1, kind="stable")[:, :FIRST]

    def of(self, group: int, lo: float, hi: float) -> np.ndarray:
        mine = (self.first == group).any(axis=1)
        if self.reached is None:  # the first look: the nearest groups
            return np.flatnonzero(mine)
        gap = np.maximum(0, np.maximum(self.angle[:, group] - hi, lo - self.angle[:, group]))
        return np.flatnonzero(~mine & (np.cos(np.minimum(gap, np.pi)) >= self.reached - SLACK))


def _multiplied(asked: _Asked, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for group, lo, hi, ids, flat in zip(*(b.column(c).to_pylist() for c in ("group", "lo", "hi", "ids", "vectors"))):
                rows = asked.of(group, lo, hi)
                if not len(rows):
                    continue
                score = np.round(asked.x[rows] @ np.frombuffer(flat).reshape(len(ids), -1).T, 9)
                at = np.array(ids, np.int64)
                for r, s in zip(rows.tolist(), score):
                    old = kept.get(r)
                    s, c = (s, at) if old is None else (np.concatenate([old[0], s]), np.concatenate([old[1], at]))
                    order = np.lexsort((c, -s))[:n]
                    kept[r] = (s[order], c[order])
        for r, (s, c) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), asked.ids[r])), pa.array(c), pa.array(s)], SCORES.names)

    return run


def _counted(first: _Asked, then: _Asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = every = 0
        for b in batches:
            for group, lo, hi, n in zip(*(b.column(c).to_pylist() for c in ("group", "lo", "hi", "n"))):
                done += n * (len(first.of(group, lo, hi)) + len(then.of(group, lo, hi)))
                every += n * len(first.ids)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([every], pa.int64())], ["products", "all"])

    return run


def searched(index: DenseIndex, queries: DataFrame, n: int, at_once: int = QUESTIONS) -> DenseSearch:
    """queries: query_id, embedding; those without a vector of the index's length find nothing. Up to about at_once questions go to
    the workers in a pass; more take further passes over the blocks, so neither the driver nor a task sees them all."""
    dim, spark = index.centres.shape[1], index.blocks.sparkSession
    usable = queries.filter((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull())).select("query_id", "embedding")
    passes = max(1, -(-usable.count() // at_once)) if len(index.centres) else 0
    out, work = spark.createDataFrame([], "query_id long, chunk_id long, score double"), spark.createDataFrame([], "products long, all long")
    schema = "query_id long, chunk_id long, score double"
    for k in range(passes):
        rows = usable.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == k).collect()
        if not rows:
            continue
        ids, x = np.array([r[0] for r in rows], np.int64), _unit([r[1] for r in rows])
        first = _Asked(ids, x, index.centres, None)
        early = written(best(index.blocks.mapInArrow(_multiplied(first, n), schema), n, F.desc("score"), "chunk_id").drop("place"), "early", rows=len(rows) * n)
        least = {r[0]: r[1] for r in early.groupBy("query_id").agg(F.when(F.count("*") == n, F.min("score"))).collect()}
        reached = np.array([-2.0 if (v := least.get(i)) is None else v for i in ids.tolist()])
        then = _Asked(ids, x, index.centres, reached)
        out = out.unionByName(early).unionByName(index.blocks.mapInArrow(_multiplied(then, n), schema))
        work = work.unionByName(index.blocks.select("group", "lo", "hi", F.size("ids").alias("n")).mapInArrow(_counted(first, then), "products long, all long"))
    return DenseSearch(out, work.agg(F.coalesce(F.sum("products"), F.lit(0)).alias("products"), F.coalesce(F.sum("all"), F.lit(0)).alias("all")))


def topk(index: DenseIndex, queries: DataFrame, n: int, floor: float = FLOOR) -> DataFrame:
    """The n best of each query that reach the floor: query_id, rank0, chunk_id, score; what dense_topk gives."""
    return ranked(searched(index, queries, n).scores, n, least=floor).select("query_id", "rank0", "chunk_id", "score")
