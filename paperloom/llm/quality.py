"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes a few statistics of its characters and words. Cosines of random projections of the standardised
statistics approximate a Gaussian kernel. Each partition sums its part of the normal equations, the parts are added in
two levels, and the driver solves small systems. Rows are in FOLDS folds by their doc_id; raw scores of each fold under
the weights of the others are counted in a fixed number of bins, with their labels, and a monotone step fit over the
bins, joined by lines between its levels, gives the score: how likely label 1 is. Scores then come from the weights of all folds together.

Labels are learned from all labelled rows that aren't held out; nothing is sampled.

Nulls and edge cases: a null text counts as empty and is scored by its statistics (all zero); a null doc_id is never
held out and has no label; labels other than 0 and 1 are left out; without labels of both kinds every score is the
labels' mean, or 0.5 without any; repeated rows each give a row; a very long text is measured in parts; an empty table
gives no rows; other columns are ignored, and where they are to be kept, ones called score or predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import discard, prepare, release, spare, undotted, utf8, without, written
from paperloom.llm.shingles import words

NAMES = ("chars", "letters", "upper", "digits", "spaces", "stops", "bangs", "symbols", "wide", "word_length", "distinct", "top", "again", "pairs")
#: Random features, the kernel's width in standard deviations, ridge, bins of raw scores, limits of raw scores.
FEATURES, KERNEL_WIDTH, RIDGE, BINS, LOW, HIGH = 256, 3.0, 1e-4, 2048, -0.5, 1.5
FOLDS = 5
THRESHOLD = 0.3


def _class(keep) -> np.ndarray:
    return np.array([bool(keep(i)) for i in range(256)])


_LETTER = _class(lambda i: chr(i).isalpha() if i < 128 else i >= 0xC0)
_CLASSES = (
    _class(lambda i: not 0x80 <= i < 0xC0),  # characters
    _LETTER,
    _class(lambda i: 65 <= i <= 90),
    _class(lambda i: 48 <= i <= 57),
    _class(lambda i: i in (9, 10, 11, 12, 13, 32)),
    _class(lambda i: chr(i) in ".,;:?'\"()-"),
    _class(lambda i: chr(i) == "!"),
    _class(lambda i: 32 < i < 127 and not chr(i).isalnum() and chr(i) not in ".,;:?'\"()-!"),
    _class(lambda i: i >= 0xC0),
)


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts x NAMES."""
    counts = np.zeros((len(_CLASSES), len(off) - 1))
    for lo in range(0, len(buf), 1 << 20):  # in parts, so that long texts need no more memory than short ones
        part, at = buf[lo : lo + (1 << 20)], np.clip(off - lo, 0, 1 << 20)
        at = np.minimum(at, len(part))
        for k, c in enumerate(_CLASSES):
            sums = np.concatenate([[0], np.cumsum(c[part], dtype=np.int32)])
            counts[k] += np.diff(sums[at])
    chars, letters, upper, digits, spaces, stops, bangs, symbols, wide = counts
    some, lettered = np.maximum(chars, 1), np.maximum(letters, 1)
    h, first = words(buf, off)
    n = np.diff(first)
    w = np.maximum(n, 1)
    distinct, top, again, pairs = np.zeros((4, len(n)))
    same = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        np.cumsum(h[1:] == h[:-1], out=same[2:])
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) > 1 else h[:0]
    for i, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if hi <= lo:
            continue
        s = np.sort(h[lo:hi])
        edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
        if hi - lo > 1:
            again[i] = same[hi] - same[lo + 1]
            p = np.sort(two[lo : hi - 1])
            pairs[i] = 1 - (1 + np.count_nonzero(p[1:] != p[:-1])) / len(p)
    return np.column_stack([np.log1p(chars), letters / some, upper / lettered, digits / some, spaces / some, stops / some, bangs / some, symbols / some, wide / lettered, np.log1p(letters / w), distinct / w, top / w, again / w, pairs])


_STATISTICS = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def _measure(keep: list[str], name: str):
    """The columns to keep, and the texts' statistics as a struct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x = statistics(*utf8(b.column("text")))
            struct = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(x.T)], list(NAMES))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), struct], [*keep, name])

    return run


class Model:
    """From statistics to scores."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.project = rng.normal(0, 1 / KERNEL_WIDTH, (len(NAMES), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps = (np.zeros(1), np.full(1, 0.5))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.project + self.phase) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[list[float]]:
    """Pool adjacent violators, in the order of x: blocks of sum of x, sum of y, weight, first and last x."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a * w, b * w, w, a, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [*(p + q for p, q in zip(blocks[-1][:3], last[:3])), blocks[-1][3], last[4]]
    return blocks


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' mean places and non-decreasing means."""
    blocks = pooled(x, y, weight)
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def knots(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The monotone fit as a line that is level over each block and rises between them."""
    ends = [(place, b[1] / b[2]) for b in pooled(x, y, weight) for place in sorted({b[3], b[4]})]
    return np.array([p for p, _ in ends]), np.array([v for _, v in ends])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(n).to_numpy() for n in NAMES]) if b.num_rows else np.zeros((0, len(NAMES)))


def _normal(model: Model):
    """Each fold's sums for the normal equations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2))
        for b in batches:
            f, fold, y = model.features(_matrix(b)), b.column("fold").to_numpy(), b.column("y").to_numpy()
            for k in range(FOLDS):
                total[k] += f[fold == k].T @ np.column_stack([f, y])[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FOLDS * (FEATURES + 1) * (FEATURES + 2))
    for b in batches:
        for part in b.column("part").to_pylist():
            total += np.frombuffer(part)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights; the constant, which is the last feature, is hardly held back. Its sum of squares counts the rows."""
    n = max(sums[-1, -2], 1.0)
    ridge = np.eye(FEATURES + 1) * RIDGE * n
    ridge[-1, -1] = 1e-9 * n
    return np.linalg.solve(sums[:, :-1] + ridge, sums[:, -1])


def _raw(model: Model, weights: list[np.ndarray]):
    """Bins of raw scores: a row is scored by the weights at its fold's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, fold = model.features(_matrix(b)), b.column("fold").to_numpy()
            raw = np.clip((f @ np.column_stack(weights))[np.arange(len(f)), fold], LOW, HIGH)
            bins = ((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int32).clip(0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), b.column("y")], ["bin", "y"])

    return run


def _scorer(model: Model):
    @F.arrow_udf(T.DoubleType())
    def score(statistics_: pa.Array) -> pa.Array:
        return pa.array(model.score(np.column_stack([statistics_.field(n).to_numpy() for n in NAMES])) if len(statistics_) else [], pa.float64())

    return score


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """measured: doc_id, held_out, NAMES; labels: doc_id, quality."""
    spark = measured.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y in (0, 1)")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = written(measured.filter("not held_out").join(marks, "doc_id").select("y", fold, *NAMES), "train")
    sums = train.agg(F.count("*"), F.avg("y"), *(f(n) for n in NAMES for f in (F.avg, F.stddev_pop))).first()
    n, mean_y = sums[0], sums[1]
    if not n or mean_y in (0.0, 1.0):
        model = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)))
        model.steps = (np.zeros(1), np.full(1, mean_y if n else 0.5))
        return model
    scale = np.array(sums[3::2], float)
    model = Model(np.array(sums[2::2], float), np.where(scale > 1e-9, scale, 1.0))
    parts = train.mapInArrow(_normal(model), "part binary")
    width = max(1, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    total = parts.repartition(width).mapInArrow(_add, "part binary").repartition(1).mapInArrow(_add, "part binary").first()
    a = np.frombuffer(bytes(total[0])).reshape(FOLDS, FEATURES + 1, FEATURES + 2)
    model.weights = solved(a.sum(axis=0))
    # a fold that holds all rows has no others: it is scored by its own weights
    crossed = [solved(a.sum(axis=0) - a[k]) if a[k, -1, -2] < n else model.weights for k in range(FOLDS)]
    rows = np.array(train.mapInArrow(_raw(model, crossed), "bin int, y double").groupBy("bin").agg(F.avg("y"), F.count("*")).orderBy("bin").collect(), float)
    model.steps = knots(LOW + (rows[:, 0] + 0.5) * (HIGH - LOW) / BINS, rows[:, 1], rows[:, 2])
    discard(train)
    return model


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _with_scores(measured: DataFrame, name: str, labels: DataFrame) -> DataFrame:
    """measured (doc_id, held_out and statistics called name; written) with score and predicted."""
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), f"{name}.*"), labels)
    return measured.withColumn("score", _scorer(model)(F.col(name))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, held_out, score, predicted. Texts are read once: their statistics are
    written and serve both training and scoring."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*texts.schema.fields[:2], T.StructField("statistics", _STATISTICS)])
    measured = written(texts.mapInArrow(_measure(["doc_id", "held_out"], "statistics"), schema), "statistics")
    return _with_scores(measured, "statistics", labels).select("doc_id", "held_out", "score", "predicted")


def _measured_and_scored(model: Model, names: list[str], name: str):
    """Statistics and score in one worker: two Python steps of a plan would be two workers a task, which stay."""
    measure = _measure(names, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in measure(batches):
            found = b.column(len(names))
            score = model.score(np.column_stack([found.field(n).to_numpy() for n in NAMES])) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score, pa.float64())], [*names, "score"])

    return run


def annotated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with score and predicted, in the place of columns that were called so.
    Texts are measured for training, of which only the statistics are written, and again where they are scored: so they are
    neither shuffled nor written, and the result reads docs alone."""
    prepare(docs.sparkSession)
    docs = without(docs, "score", "predicted")
    names, docs = docs.columns, undotted(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).filter("not held_out")
    schema = T.StructType([*texts.schema.fields[:2], T.StructField("statistics", _STATISTICS)])
    measured = written(texts.mapInArrow(_measure(["doc_id", "held_out"], "statistics"), schema), "statistics")
    model = fit(measured.select("doc_id", "held_out", "statistics.*"), labels)
    discard(measured)
    (name,) = spare(docs, "statistics")
    rows = docs.mapInArrow(_measured_and_scored(model, docs.columns, name), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).toDF(*names, "score", "predicted")
