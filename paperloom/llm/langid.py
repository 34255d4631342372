"""Language ID by a byte convolutional network.

Bytes are embedded, filters of several widths slide over windows of fixed length, each filter's largest response in a
window is kept, and a softmax over these gives the window's language. The network learns in numpy by Adam from all windows of
all labelled texts: each task goes over its rows' windows from the same start, and the tasks' networks are averaged, by their
windows. It starts from one that is trained on a bounded sample of labelled texts (PER_LANG different texts a language at most, those with the least hashes of doc_id and
text; fewer where languages are so many that the whole sample would exceed TEXTS, but LEAST_TEXTS at least; WINDOWS
windows of each; every value of lang is learned, and none without a text): only where a window's
largest responses lie does a gradient flow, so a step costs little more than a forward pass. A text is read whole, in
windows side by side; its language is that of the mean log probability over its windows.

Nulls and edge cases: a null text or one without letters is `und` with score 0; a null lang or doc_id isn't learned
from; an empty table, or one without any label, gives `und` for all; repeated rows each give a row; long texts are
worked off in batches of windows; other columns are ignored, and where they are to be kept, ones called lang_pred or
score are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import discard, prepare, release, strings, undotted, utf8, without, written

WINDOW = 256
NONE = "und"
WIDTHS, FILTERS, EMBED = (2, 3, 4, 5), 8, 6
#: The sample's bound: texts a language, windows a text, texts; but LEAST_TEXTS a language however many there are.
PER_LANG, WINDOWS, TEXTS, LEAST_TEXTS = 2500, 3, 100_000, 20
#: Bits of a trigram's hash; the share of held-out windows that may be odd, and how much further off a text has to be.
TRIGRAM_BITS, FEWEST, SLACK = 18, 0.01, 5.0
#: Steps that training takes at least, however few windows there are.
LEAST_STEPS = 1500
#: Windows that are worked on at once; the rate at which tasks learn from all windows, and windows of a step there.
BATCH, RATE, STEP = 512, 1e-3, 64
#: Languages whose trigrams a task counts before it passes them on; precision of quantiles over all held-out windows.
HELD_LANGS, PRECISION = 16, 100_000


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # widest * EMBED x all filters, zero where a filter is narrower
    bias: np.ndarray
    weights: np.ndarray  # all filters x languages
    offset: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches (windows x places x widest * EMBED) and the filters' responses."""
        widest = max(WIDTHS)
        x = self.embed[windows].reshape(len(windows), -1)
        places = windows.shape[1] - widest + 1
        step = x.strides[1]
        patches = np.lib.stride_tricks.as_strided(x, (len(windows), places, widest * EMBED), (x.strides[0], step * EMBED, step))
        patches = np.ascontiguousarray(patches).reshape(-1, widest * EMBED)
        return patches, (patches @ self.filters).reshape(len(windows), places, -1)

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        _, r = self.responses(windows)
        z = np.maximum(r.max(axis=1) + self.bias, 0) @ self.weights + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _mask() -> np.ndarray:
    widest = max(WIDTHS)
    return np.concatenate([np.repeat((np.arange(widest * EMBED) < w * EMBED)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).astype(np.float32)


def gradients(net: Net, w: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted mean cross entropy of windows w with languages y, and what it changes by with each of the network's
    arrays, in their order."""
    widest, one = max(WIDTHS), np.arange(len(y))
    patches, r = net.responses(w)
    best = r.argmax(axis=1)  # windows x filters
    top = np.take_along_axis(r, best[:, None, :], axis=1)[:, 0] + net.bias
    pooled = np.maximum(top, 0)
    z = pooled @ net.weights + net.offset
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = float((-np.log(np.maximum(p[one, y], 1e-30)) * weigh[y]).mean())
    p[one, y] -= 1
    p *= weigh[y][:, None] / len(y)
    back = (p @ net.weights.T) * (top > 0)
    picked = patches.reshape(len(w), -1, widest * EMBED)[one[:, None], best]  # windows x filters x patch
    g_filters = np.einsum("wf,wfk->kf", back, picked) * _mask()
    g_patch = back[:, :, None] * net.filters.T[None]  # windows x filters x patch
    g_embed = np.zeros_like(net.embed)
    byte = w[one[:, None, None], best[:, :, None] + np.arange(widest)]
    np.add.at(g_embed, byte.reshape(-1), g_patch.reshape(-1, EMBED))
    return loss, [g_embed, g_filters, back.sum(0), pooled.T @ p, p.sum(0)]


def started(langs: list[str], rng: np.random.Generator) -> Net:
    mask, f32 = _mask(), np.float32
    n = mask.shape[1]
    return Net(langs, rng.normal(0, 0.5, (256, EMBED)).astype(f32), (rng.normal(0, 0.3, mask.shape) * mask).astype(f32), np.zeros(n, f32), rng.normal(0, 0.1, (n, len(langs))).astype(f32), np.zeros(len(langs), f32))


class Adam:
    """Moves arrays, in place, along their gradients."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays, self.t = arrays, 0
        self.m, self.v = [np.zeros_like(x) for x in arrays], [np.zeros_like(x) for x in arrays]

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for x, m, v, g in zip(self.arrays, self.m, self.v, gradients):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Net:
    """windows: n x WINDOW bytes; labels: places in langs. Languages weigh the same however many windows they have."""
    rng, f32 = np.random.default_rng(seed), np.float32
    net = started(langs, rng)
    adam = Adam(net.arrays())
    share = np.bincount(labels, minlength=len(langs)).clip(1)
    weigh = (len(labels) / len(langs) / share).astype(f32)
    epochs = max(epochs, -(-LEAST_STEPS * batch // max(1, len(labels))))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            step = rate * (1 - 0.9 * (epoch * len(order) + lo) / (epochs * len(order)))
            adam.step(gradients(net, windows[at], labels[at], weigh)[1], step)
    return net


def cut(text: np.ndarray) -> np.ndarray:
    """A text's windows, side by side; the last is filled with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = text
    return out.reshape(n, WINDOW)


def predict(net: Net, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language place and its probability for each text."""
    size = np.diff(off)
    many = np.maximum(1, -(-size // WINDOW))
    total, text, lo = np.zeros((len(size), len(net.langs))), 0, 0
    while text < len(size):  # fill a batch with windows of one text after the other
        windows, owner = [], []
        room = BATCH
        while room and text < len(size):
            take = min(room, int(many[text]) - lo)
            windows.append(cut(buf[off[text] + lo * WINDOW : min(off[text] + (lo + take) * WINDOW, off[text + 1])]))
            owner += [text] * take
            room -= take
            lo += take
            if lo == many[text]:
                text, lo = text + 1, 0
        np.add.at(total, owner, net.log_probs(np.concatenate(windows)))
    mean = total / many[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return p.argmax(axis=1), p.max(axis=1)


def _sample(windows_a_text: int):
    """Per row: lang, key, and its windows' bytes one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            (buf, off), out = utf8(b.column("text")), []
            for i in range(b.num_rows):
                w = cut(buf[off[i] : off[i + 1]])
                # windows spread over the text; the first one starts at a byte that the text decides
                at = np.unique((np.arange(windows_a_text) + zlib.crc32(w[0].tobytes()) / 2**32) * len(w) // windows_a_text).astype(int)
                out.append(w[np.minimum(at, len(w) - 1)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("key"), pa.array(out, pa.binary())], ["lang", "key", "bytes"])

    return run


#: Bytes of words: space, ASCII letters, and all of longer characters.
_WORD = np.array([b == 32 or b >= 128 or chr(b).isalpha() for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)


@dataclass
class Familiar:
    """How likely a text's byte trigrams are in the learned languages together, and how likely they have to be."""

    log_p: np.ndarray  # by trigram's hash
    least: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean log probability of each text's trigrams of letters and spaces; 0 where there are none to tell by."""
        out = np.zeros(len(off) - 1)
        for i in range(len(out)):
            got, n = 0.0, 0
            for lo in range(int(off[i]), int(off[i + 1]), 1 << 20):
                at, whole = _trigrams(buf[lo : min(lo + (1 << 20) + 2, off[i + 1])])
                got, n = got + float(self.log_p[at[whole]].sum(dtype=np.float64)), n + int(whole.sum())
            out[i] = got / n if n else 0.0
        return out


def _trigrams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trigrams of bytes, and which of them have letters and spaces only (numbers, codes and the zero
    bytes that fill windows are of no language). ASCII capitals count as small letters."""
    ok, b = _WORD[b], _LOWER[b]
    code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - TRIGRAM_BITS), ok[:-2] & ok[1:-1] & ok[2:]


@dataclass
class Sample:
    """Windows, the place of each one's language, and the languages."""

    windows: np.ndarray
    labels: np.ndarray
    langs: list[str]


def familiar(docs: DataFrame, langs: list[str]) -> Familiar:
    """Learns the trigrams of all windows that the network learns from, each language counting the same. All held-out windows tell
    how likely is enough: their median less SLACK times its distance to their FEWEST quantile. Counts are summed up by
    Spark; a number for each hash and two quantiles reach the driver."""
    counts = _labelled(docs.filter(~held_out())).select("lang", "text").mapInArrow(_count_trigrams, "lang string, code int, n long")
    counts = written(counts.groupBy("lang", "code").agg(F.sum("n").alias("n")), "trigrams")
    shares = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").groupBy("code").agg(F.sum(F.col("n") / F.col("all")).alias("p")).toArrow()
    discard(counts)
    p = np.zeros(1 << TRIGRAM_BITS)
    p[shares.column("code").to_numpy()] = shares.column("p").to_numpy() / len(langs)
    got = Familiar(np.log(0.99 * p + 0.01 / len(p)).astype(np.float32), -np.inf)
    scores = _labelled(docs.filter(held_out())).select("text").mapInArrow(_window_scores(got), "score double")
    low, middle = scores.agg(F.percentile_approx("score", FEWEST, PRECISION), F.percentile_approx("score", 0.5, PRECISION)).first()
    if middle is not None:
        got.least = middle - SLACK * (middle - low)
    return got


def _windows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's place and windows, BATCH at a time."""
    buf, off = utf8(b.column("text"))
    for i in range(b.num_rows):
        for lo in range(int(off[i]), max(int(off[i]) + 1, int(off[i + 1])), BATCH * WINDOW):
            yield i, cut(buf[lo : min(lo + BATCH * WINDOW, off[i + 1])])


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    held: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "code", "n"])
        held.clear()

    for b in batches:
        langs = b.column("lang").to_pylist()
        for i, w in _windows(b):
            if langs[i] not in held and len(held) >= HELD_LANGS:
                yield from counted()
            code, whole = _trigrams(np.pad(w, ((0, 0), (0, 1))).reshape(-1))
            np.add.at(held.setdefault(langs[i], np.zeros(1 << TRIGRAM_BITS, np.int64)), code[whole], 1)
    yield from counted()


def _window_scores(known: Familiar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for _, w in _windows(b):
                code, whole = _trigrams(np.pad(w, ((0, 0), (0, 2))).reshape(-1))
                code, whole = (np.append(x, [0, 0]).reshape(len(w), -1)[:, : WINDOW - 2] for x in (code, whole))
                n = whole.sum(axis=1)
                score = (known.log_p[code.astype(np.int64)] * whole).sum(axis=1, dtype=np.float64)[n > 0] / n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(score)], ["score"])

    return run


def _labelled(docs: DataFrame) -> DataFrame:
    """The rows that have a doc_id, a text and a language, with these."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.filter("doc_id is not null and lang is not null and text is not null")


def _learn(net: Net, weigh: np.ndarray):
    """A task's network after all windows of its rows, in one row: its arrays and how many windows they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        place = {lang: i for i, lang in enumerate(net.langs)}
        mine = Net(net.langs, *[x.copy() for x in net.arrays()])
        adam, seen = Adam(mine.arrays()), 0
        waiting, labels, n = [], [], 0

        def learned() -> int:
            w, y = np.concatenate(waiting), np.array(labels)
            order = np.random.default_rng(len(w)).permutation(len(w))  # neighbours are of one text
            for lo in range(0, len(w), STEP):
                at = order[lo : lo + STEP]
                adam.step(gradients(mine, w[at], y[at], weigh)[1], RATE)
            waiting.clear()
            labels.clear()
            return len(w)

        for b in batches:
            langs = b.column("lang").to_pylist()
            for i, w in _windows(b):
                waiting.append(w)
                labels += [place[langs[i]]] * len(w)
                n += len(w)
                if n >= 8 * BATCH:
                    seen, n = seen + learned(), 0
        if waiting:
            seen += learned()
        if seen:
            flat = np.concatenate([x.reshape(-1) for x in mine.arrays()]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tolist()])], ["seen", "flat"])

    return run


def learned_from_all(net: Net | None, docs: DataFrame) -> Net | None:
    """The network after all windows of docs' labelled rows: tasks learn from theirs side by side, and a task's arrays, some
    thousands of numbers, are averaged by how many windows they saw. Languages weigh the same, as in train()."""
    if net is None:
        return None
    rows = _labelled(docs).filter(F.col("lang").isin(net.langs) if len(net.langs) <= 1000 else F.lit(True)).select("lang", "text")
    n_windows = F.sum(F.greatest(F.ceil(F.octet_length("text") / WINDOW), F.lit(1)))
    n = dict(rows.groupBy("lang").agg(n_windows.alias("n")).collect())
    share = np.array([n.get(lang, 1) for lang in net.langs], np.float64)
    weigh = (share.sum() / len(share) / share).astype(np.float32)
    every = F.posexplode("flat").alias("at", "x")
    parts = written(rows.mapInArrow(_learn(net, weigh), "seen long, flat array<double>"), "networks", rows=1)
    mean = parts.select("seen", every).groupBy("at").agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x")).orderBy("at").toArrow()
    discard(parts)
    flat, at, arrays = mean.column("x").to_numpy().astype(np.float32), 0, []
    for x in net.arrays():
        arrays.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    return Net(net.langs, *arrays)


def sampled(labelled: DataFrame, per_lang: int = PER_LANG, windows: int = WINDOWS) -> Sample | None:
    """labelled: doc_id, text, lang. A bounded sample of the rows that have a text and a language; None without any.

    A text's key hashes doc_id and text. Each language's number of different keys is estimated, and rows are read whose
    keys lie below a share that leaves somewhat more than per_lang of them; all, where there are no more. Repeated rows
    become one before they reach the driver, which sorts by key and cuts off exactly at per_lang."""
    spark = prepare(labelled.sparkSession)
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()
    if not counts:
        return None
    per_lang = min(per_lang, max(LEAST_TEXTS, TEXTS // len(counts)))
    more = 1.15 * per_lang + 5 * math.sqrt(per_lang) + 16
    shares = spark.createDataFrame([(lang, min(1.0, more / max(1, n))) for lang, n in counts], "lang string, share double")
    picked = rows.join(F.broadcast(shares), "lang").filter(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    picked = picked.select("lang", "key", "text").mapInArrow(_sample(windows), "lang string, key long, bytes binary")
    got = picked.groupBy("lang", "key").agg(F.min("bytes").alias("bytes")).toArrow()
    # below a share keys go by their value modulo 2**30, so that is their order
    key = got.column("key").to_numpy()
    texts = sorted(zip(got.column("lang").to_pylist(), (key % (1 << 30)).tolist(), key.tolist(), got.column("bytes").to_pylist()))
    langs, labels, parts, taken = sorted({t[0] for t in texts}), [], [], 0
    place = {lang: i for i, lang in enumerate(langs)}
    for i, (lang, _, _, some) in enumerate(texts):
        taken = taken + 1 if i and texts[i - 1][0] == lang else 1
        if taken <= per_lang:
            parts.append(some)
            labels += [place[lang]] * (len(some) // WINDOW)
    return Sample(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WINDOW), np.array(labels), langs)


def fit(sample: Sample | None) -> Net | None:
    return None if sample is None else train(sample.windows, sample.labels, sample.langs)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, per_lang: int = PER_LANG) -> Net | None:
    """Learns from all rows of docs (doc_id, text, lang) that have all three and aren't held out; a sample of them is the start."""
    mine = docs.filter(~held_out())
    return learned_from_all(fit(sampled(mine, per_lang)), mine)


def fitted_with_familiar(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[Net | None, Familiar | None]:
    """The network and the trigrams, from all rows that aren't held out, and the threshold from all that are."""
    net = fitted(docs, per_lang)
    return net, None if net is None else familiar(docs, net.langs)


def annotated(docs: DataFrame, net: Net | None, known: Familiar | None = None) -> DataFrame:
    """docs (any columns with text) with lang_pred and score, in the place of columns that were called so; with known, a
    text that isn't likely enough there is `und` with score 0 too."""
    prepare(docs.sparkSession)
    docs = without(docs, "lang_pred", "score")
    names, docs = docs.columns, undotted(docs)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(net, known), schema).toDF(*names, "lang_pred", "score")


def identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """docs: doc_id, text, lang. Per row: doc_id, held_out, lang_pred, score. Learns from rows that aren't held out."""
    net = fitted(docs, per_lang)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return annotated(rows, net).drop("text")


def _predict(net: Net | None, likely: Familiar | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = strings(b.column("text"))
            known = np.array([net is not None and any(map(str.isalpha, t)) for t in texts], bool)
            if likely is not None:
                known &= likely.scores(*utf8(b.column("text"))) >= likely.least
            if net is None or not len(texts):
                lang, score = [NONE] * len(texts), np.zeros(len(texts))
            else:
                at, score = predict(net, *utf8(b.column("text")))
                lang = [net.langs[k] if ok else NONE for k, ok in zip(at.tolist(), known.tolist())]
                score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run
