"""Embedding whitening by Chan merging.

Each partition of the fit list computes count, mean and centred scatter of its vectors, batch after batch; partial
results meet pairwise in a tree on the executors, by Chan's merge formula; the driver sees one d x d matrix and takes its
eigenvectors. A second pass whitens the fit list, computes the covariance of the result in the same way, and so says how
far it is from the identity.

Vectors become whole numbers first, so that sums and distances from the mean are exact. The fit list is each distinct
vector once: repeated rows are folded before anything is shuffled (a partial aggregation), so a vector that a third of
the rows repeat costs its tasks one row each.

Nulls and edge cases: rows whose vector is null, or holds a null or a component that isn't finite, give no rows; nor do
empty vectors. Vectors of different lengths can't share a mean: each length has its own fit list, n, components and
error. A null vec_id stays null, rows that repeat a vec_id are each whitened. Of a component without variance (one
vector only, or a dimension that others make up) whitened is null and explained 0; explained is null too where nothing
varies at all, identity_error is null then. Components whose 64-fold is beyond 2**52 count as that. A deviation beyond a
long is null and stands in deviation_digits, which is null otherwise. An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, release, written
from paperloom.llm.grid import floors, is_finite, matrix, tree_merged

#: What a whole number is raised by, the largest that counts, components that are given.
PLUS, MOST, COMPONENTS = 1_000_000, 1 << 52, 16
LONG = (1 << 63) - 1


@dataclass
class Moments:
    """Of some vectors: count, exact sums, mean, and scatter about the mean. Values are taken less an origin."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(y: np.ndarray, whole: bool = True) -> Moments:
    mean = y.mean(axis=0, dtype=np.float64)
    centred = y - mean
    # a batch has 1,000 rows, so sums of numbers below 2**53 stays within a long
    sums = [int(s) for s in y.sum(axis=0)] if whole else []
    return Moments(len(y), sums, mean, centred.T @ centred)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan, Golub and LeVeque's formula for two disjoint lots."""
    n = a.n + b.n
    step = b.mean - a.mean
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums)], a.mean + step * (b.n / n), a.scatter + b.scatter + np.outer(step, step) * (a.n * b.n / n))


def _merged_by_length(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return a | {d: merged(a[d], m) if d in a else m for d, m in b.items()}


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a batch's vectors of each length (of one at least), and these vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == d)
        yield at, matrix(column.take(pa.array(at)))


def _partition(values):
    """One row a partition: the moments of what `values` makes of its vectors, by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: dict[int, Moments] = {}
        for b in batches:
            for _, x in _by_length(b.column("x")):
                if (got := values(x)) is not None:
                    found = _merged_by_length(found, {x.shape[1]: got})
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["state"])

    return run


def _totals(rows: DataFrame, values) -> dict[int, Moments]:
    states = rows.mapInArrow(_partition(values), "state binary")
    return tree_merged(states, lambda r: pickle.loads(r[0]), _merged_by_length) or {}


@dataclass(frozen=True)
class Whitening:
    """Of vectors of one length: n and the sums of the fit list, unit eigenvectors as rows by falling eigenvalue, the
    eigenvalues (0 where there is no variance), their trace, and the largest departure from the identity."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: whole parts first, so that no digit goes."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - low) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened vectors; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)
        out[:, self.eigenvalues <= 0] = np.nan
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S) squared, exactly: with x = low + y and S = n * low + r that is
        n * n * sum(y * y) - 2 * n * sum(y * r) + sum(r * r)."""
        low, r = [s // self.n for s in self.sums], [s % self.n for s in self.sums]
        y = x - np.array(low, np.int64)
        widest = int(np.abs(y).max(initial=0))
        if x.shape[1] * widest * max(widest, self.n) > LONG:  # beyond longs: whole numbers of any size
            y, r_ = y.astype(object), np.array(r, object)
        else:
            r_ = np.array(r, np.int64)
        squares, mixed, own = (y * y).sum(axis=1), (y * r_).sum(axis=1), sum(v * v for v in r)
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + own for a, b in zip(squares, mixed)]


def solved(m: Moments, k: int, origin: int) -> Whitening:
    """Eigenvectors of the covariance (divisor n), the k of the largest eigenvalues."""
    cov = m.scatter / m.n
    e, v = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(e)[::-1][:k]
    trace = float(np.trace(cov))
    noise = trace * len(e) * np.finfo(float).eps
    e = np.where(e[order] > noise, e[order], 0.0)
    return Whitening(m.n, tuple(s + m.n * origin for s in m.sums), np.ascontiguousarray(v[:, order].T), e, trace)


def on_grid(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with x: its components as whole numbers."""
    return vectors.filter(is_finite(column)).withColumn("x", floors(column, MOST, PLUS))


def fit(rows: DataFrame, k: int = COMPONENTS) -> dict[int, Whitening]:
    """rows: x. The whitening of each length of vectors, from each distinct x once, verified by a second pass."""
    fit_list = written(rows.select("x").distinct(), "fit-list")
    found = _totals(fit_list, lambda x: moments(x - PLUS))
    models = {d: solved(m, k, PLUS) for d, m in found.items()}
    again = _totals(fit_list, lambda x: moments(y, False) if (y := (w := models[x.shape[1]]).project(x)[:, w.eigenvalues > 0]).shape[1] else None)
    discard(fit_list)
    error = {d: float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()) for d, m in again.items()}
    return {d: replace(w, identity_error=error.get(d)) for d, w in models.items()}


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def _rows(models: dict[int, Whitening]):
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            ids = b.column("vec_id")
            for at, x in _by_length(b.column("x")):
                w = models[x.shape[1]]
                k = len(w.eigenvalues)
                exact = w.deviations(x)
                every = np.repeat(np.arange(len(at)), k)
                fits = pa.array([d if d <= LONG else None for d in exact], pa.int64())
                digits = pa.array([None if d <= LONG else str(d) for d in exact], pa.string())
                explained = [e / w.trace if w.trace > 0 else None for e in w.eigenvalues]
                columns = [
                    ids.take(pa.array(at[every])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(every), w.n, np.int64)),
                    fits.take(pa.array(every)),
                    pa.array(w.project(x).ravel(), from_pandas=True),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([w.identity_error] * len(every), pa.float64()),
                    digits.take(pa.array(every)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vectors: vec_id, embedding. One row a vector and component up to k: vec_id, component, n, deviation, whitened,
    explained, identity_error, deviation_digits."""
    prepare(vectors.sparkSession)
    rows = on_grid(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).select("vec_id", "x")
    return rows.mapInArrow(_rows(fit(rows, k)), OUT)
