"""Suffix-array dedup: remove every byte that a repeated string of SIZE bytes covers.

Suffixes are dealt to buckets by content: a window of SIZE bytes goes to the bucket of the least hash of its GRAM-byte
grams, so equal windows meet in one bucket and neighbouring windows mostly share one. A stretch of windows of one
bucket travels as one piece of text. Only buckets that at least two stretches of the corpus name are built; equal
stretches become one row with a weight. A task sorts its buckets one block at a time (see suffixes.py). A bucket with
very many different stretches is split into smaller suffix buckets: first by windows' places around the gram and the
bytes that FEW neighbouring windows share; where that is still too large, by the leading SIZE - 1 bytes of each window,
so that at most 256 different windows, each with a weight, are left to a bucket. All are sorted in the same way.

Equal texts are found by digest; one of each is looked into, and of those that have copies every window is repeated.

Nulls and edge cases: a null text counts as empty; a text of under SIZE bytes has no window; null doc_ids and repeated
rows are rows like others (a repeated row repeats its windows); an empty table gives no rows; other columns are
ignored. Bytes are removed without regard to characters; stripped() gives texts, so there a character that loses some
of its bytes goes whole: up to 3 bytes more at either end of a removed run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, release, spare, undotted, utf8, written
from paperloom.llm.shingles import mix
from paperloom.llm.suffixes import repeated

SIZE, GRAM = 200, 48
#: Grams of a window; windows hashed at once (places must fit the low bits of a hash); bytes of a block.
WIDTH, CHUNK, BLOCK = SIZE - GRAM + 1, 1 << 18, 1 << 20
#: Different stretches from which a bucket is split further, and the windows of a row then.
LARGE, FEW = 500, 16
_U = np.uint64
_BYTE = np.random.default_rng(77001).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PLACE = _U((1 << 19) - 1)

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _grams(text: np.ndarray) -> np.ndarray:
    """Hashes of the grams: 16 + 32 bytes, by doubling."""
    h, n = _BYTE[text], 1
    for step in _STEP[:4]:
        h = h[:-n] * step + h[n:]
        n *= 2
    h32 = h[:-16] * _STEP[4] + h[16:]
    return mix(h[: len(h32) - 16] * _STEP[5] + h32[16:])


def stretches(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a text, its stretches: bucket, first window, number of windows, place of the gram."""
    last = len(text) - SIZE + 1
    for lo in range(0, max(last, 0), CHUNK):
        part = text[lo : lo + CHUNK + SIZE - 1]
        grams = _grams(part)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        n = 1
        while 2 * n <= WIDTH:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        low = np.minimum(low[: len(low) - (WIDTH - n)], low[WIDTH - n :])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        gram = (low[first] & _PLACE).astype(np.int64)
        yield grams[gram].view(np.int64), first + lo, np.diff(np.append(first, len(low))), gram + lo


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    buf, off = utf8(b.column("text"))
    for i in range(b.num_rows):
        yield i, buf[off[i] : off[i + 1]]


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, bucket, n): the buckets of each text, with the number of its stretches in them."""
    names = ["row", "bucket", "n"]
    release()
    for b in batches:
        rows, buckets, counts, size = [], [], [], 0
        ids = b.column("row").to_pylist()
        for i, text in _texts(b):
            found = [bucket for bucket, *_ in stretches(text)]
            if not found:
                continue
            bucket, n = np.unique(np.concatenate(found), return_counts=True)
            rows.append(np.full(len(bucket), ids[i], np.int64))
            buckets.append(bucket)
            counts.append(n)
            size += len(bucket)
            if size > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, buckets, counts)], names)
                rows, buckets, counts, size = [], [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, buckets, counts)], names)


STRETCH = "id long, same long, bucket long, digest binary, first long, gram int, text binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a text that are in one of its buckets, with their bytes."""
    names = ["id", "same", "bucket", "digest", "first", "gram", "text"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    release()
    for b in batches:
        ids, same, buckets = (b.column(c) for c in ("id", "same", "buckets"))
        out: list[tuple] = []
        size = 0
        for i, text in _texts(b):
            wanted, raw = np.sort(buckets[i].values.to_numpy()), text.tobytes()
            who = ids[i].as_py(), same[i].as_py()
            for bucket, first, many, gram in stretches(text):
                at = np.minimum(np.searchsorted(wanted, bucket), len(wanted) - 1)
                for k in np.flatnonzero(wanted[at] == bucket).tolist():
                    lo = int(first[k])
                    piece = raw[lo : lo + int(many[k]) + SIZE - 1]
                    out.append((*who, int(bucket[k]), hashlib.blake2b(piece, digest_size=16).digest(), lo, int(gram[k]) - lo, piece))
                    size += len(piece)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


UNIT = "bucket long, unit binary, origin long, digest binary, base int, weight long, text binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of few windows, by these windows' places before the gram; the new bucket hashes the bytes they all share."""
    for b in batches:
        out: list[tuple] = []
        for bucket, digest, gram, weight, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "digest", "gram", "weight", "text"))):
            last = len(text) - SIZE
            for k in range((gram - last) // FEW, gram // FEW + 1):
                lo, hi = max(0, gram - FEW * k - FEW + 1), min(last, gram - FEW * k)
                if lo > hi:
                    continue
                core, unit = text[gram - FEW * k : gram - FEW * k - FEW + 1 + SIZE], text[lo : hi + SIZE]
                new = int.from_bytes(hashlib.blake2b(core, digest_size=8, person=str(k).encode()).digest(), "little", signed=True)
                out.append((new, hashlib.blake2b(unit, digest_size=16).digest(), bucket, digest, lo, weight, unit))
            if len(out) > 16_384:
                yield _rows(out, UNIT)
                out = []
        yield _rows(out, UNIT)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a row by itself; the new bucket is that of its leading SIZE - 1 bytes."""
    for b in batches:
        out: list[tuple] = []
        for bucket, digest, weight, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "digest", "weight", "text"))):
            for lo in range(len(text) - SIZE + 1):
                window = text[lo : lo + SIZE]
                new = int.from_bytes(hashlib.blake2b(window[:-1], digest_size=8).digest(), "little", signed=True)
                out.append((new, hashlib.blake2b(window, digest_size=16).digest(), bucket, digest, lo, weight, window))
            if len(out) > 16_384:
                yield _rows(out, UNIT)
                out = []
        yield _rows(out, UNIT)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


FOUND = "bucket long, digest binary, runs array<struct<lo:int,hi:int>>"
_RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, digest, weight, text) come by bucket; whole buckets are put in a block until it is full, and
    sorted. Gives the runs of repeated windows of each text."""
    release()
    rows: list[tuple] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "digest", "weight", "text"))):
            if size >= BLOCK and row[0] != rows[-1][0]:
                yield _sorted(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield _sorted(rows)


def _sorted(rows: list[tuple]) -> pa.RecordBatch:
    out: list[tuple] = []
    # a stretch that is alone in its bucket has nothing to compare: its own windows lie differently around its gram
    names = [None, *(r[0] for r in rows), None]
    rows = [r for i, r in enumerate(rows, 1) if r[2] > 1 or names[i] in (names[i - 1], names[i + 1])]
    for (bucket, digest, _, _), hit in zip(rows, repeated([r[3] for r in rows], [r[2] for r in rows], SIZE) if rows else ()):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        if len(edge):
            out.append((bucket, digest, [{"lo": lo, "hi": hi - 1} for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist())]))
    columns = list(zip(*out)) if out else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), _RUNS))], ["bucket", "digest", "runs"])


def _sorted_buckets(rows: DataFrame) -> DataFrame:
    """rows: bucket, digest, weight, text. The runs of repeated windows, as FOUND."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("bucket", "digest", "weight", "text").repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort, FOUND)


#: How large buckets are split, one after the other.
SPLITS = (_units, _windows)


def _found(distinct: DataFrame, docs: int, splits: tuple = SPLITS) -> DataFrame:
    """distinct: bucket, digest, weight, gram, text, written. The runs of repeated windows, as a written FOUND. docs:
    documents, which tell how far small tables are spread."""
    large = None
    if splits:
        large = distinct.groupBy("bucket").agg(F.count("*").alias("n")).filter(f"n > {LARGE}").select("bucket")
        large = written(large, "large", rows=1)
    if large is None or large.isEmpty():
        return written(_sorted_buckets(distinct), "found", rows=docs, dealt=True)
    units = distinct.join(large, "bucket").select("bucket", "digest", "gram", "weight", "text").mapInArrow(splits[0], UNIT)
    units = written(units, "units", compression="zstd", rows=docs, dealt=True)
    fewer = units.groupBy("bucket", F.col("unit").alias("digest")).agg(F.sum("weight").alias("weight"), F.lit(0).alias("gram"), F.first("text").alias("text"))
    fewer = written(fewer, "distinct-units", compression="zstd", rows=docs)
    below = _found(fewer, docs, splits[1:])
    places = units.select("bucket", "unit", "origin", F.col("digest").alias("of"), "base").join(below.withColumnRenamed("digest", "unit"), ["bucket", "unit"])
    moved = F.transform("runs", lambda r: F.struct((r["lo"] + F.col("base")).alias("lo"), (r["hi"] + F.col("base")).alias("hi")))
    # a row has few windows, so its runs are few
    back = places.groupBy(F.col("origin").alias("bucket"), F.col("of").alias("digest")).agg(F.flatten(F.collect_list(moved)).alias("runs"))
    back = written(back, "found", rows=docs)
    discard(units, fewer, below)
    rest = written(_sorted_buckets(distinct.join(large, "bucket", "left_anti")), "found", rows=docs, dealt=True)
    discard(large)
    return rest.unionAll(back)


def _windows_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last windows of each text's repeated runs, in order; numbers only, as a text may have very many."""
    outer, stretch = column.offsets.to_numpy(), column.values
    runs = stretch.field("runs")
    inner = runs.offsets.to_numpy()
    first = np.repeat(stretch.field("first").to_numpy(), np.diff(inner))
    lo, hi = (runs.values.field(n).to_numpy()[inner[0] : inner[-1]] + first for n in ("lo", "hi"))
    for i in range(len(column)):
        here = slice(inner[outer[i]] - inner[0], inner[outer[i + 1]] - inner[0])
        order = np.argsort(lo[here], kind="stable")
        yield lo[here][order], hi[here][order]


def _left(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, copied: bool) -> tuple[bytes, int, int]:
    """What stays of a text, the number of bytes that go, and of stretches of these. lo, hi: windows that start a
    repeated string, in order of lo."""
    n = len(text)
    if copied and n >= SIZE:
        return b"", n, 1
    if not len(lo):
        return text.tobytes(), 0, 0
    stop = np.maximum.accumulate(hi) + SIZE
    new = np.concatenate([[True], lo[1:] > stop[:-1]])
    starts, ends = lo[new], stop[np.concatenate([new[1:], [True]])]
    keep = np.ones(n, bool)
    for x, y in zip(starts.tolist(), ends.tolist()):
        keep[x:y] = False
    return text[keep].tobytes(), int((ends - starts).sum()), len(starts)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, copied = b.column("doc_id").to_pylist(), b.column("copied").to_pylist()
        out = []
        for (i, text), (lo, hi) in zip(_texts(b), _windows_of(b.column("runs"))):
            left, removed, count = _left(text, lo, hi, copied[i])
            out.append((ids[i], len(text), removed, count, hashlib.sha256(left).hexdigest()))
        yield _rows(out, KEPT)


def _strip(columns: list[str], runs: str, copied: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            all_, null = b.column(copied).to_pylist(), b.column("text").is_null().to_pylist()
            left = [None if null[i] else _left(text, lo, hi, all_[i])[0].decode("utf-8", "ignore") for (i, text), (lo, hi) in zip(_texts(b), _windows_of(b.column(runs)))]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if c == "text" else b.column(c) for c in columns], columns)

    return run


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: id, same (together they name a row up to repeats), row (their hash), text. Returns the stretches
    with repeated windows, as (id, same, first, runs), runs counting from first, and the rows of texts that have copies,
    as (id, same)."""
    info = docs.select("id", "same", "row", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).filter(f"n >= {SIZE}")
    info = written(info, "texts")
    count = info.count()
    sets = written(info.groupBy("md5", "n").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "sets", rows=count)
    copied = info.join(sets.filter("copies > 1").select("md5", "n"), ["md5", "n"]).select("id", "same").distinct()
    named = written(docs.mapInArrow(_name, "row long, bucket long, n long"), "buckets")
    # written, so that both sides of the join are plain shuffles, of which a hot bucket's can be split
    twice = written(named.groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1").select("bucket"), "twice", rows=count)
    per_row = named.select("row", "bucket").join(twice, "bucket").groupBy("row").agg(F.collect_set("bucket").alias("buckets"))
    per_row = per_row.join(sets.select("row"), "row", "left_semi")
    cut = docs.join(per_row, "row").select("id", "same", "text", "buckets").mapInArrow(_cut, STRETCH)
    table = written(cut, "stretches", compression="zstd", rows=count)
    discard(named, twice)
    distinct = table.groupBy("bucket", "digest").agg(F.count("*").alias("weight"), F.min("gram").alias("gram"), F.first("text").alias("text"))
    distinct = written(distinct, "distinct", compression="zstd", rows=count)
    found = _found(distinct, count)
    discard(distinct)
    return table.select("id", "same", "bucket", "digest", "first").join(found, ["bucket", "digest"]), copied


def _with_runs(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns, which _remove and _strip take, and what these are called."""
    id_, same, runs_, copied_ = spare(docs, "id", "same", "runs", "copied")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), same: F.xxhash64(F.col("doc_id").isNull(), "text")})
    texts = keyed.select(F.col(id_).alias("id"), F.col(same).alias("same"), F.xxhash64(id_, same).alias("row"), F.col("text").cast("string").alias("text"))
    runs, copied = repeated_runs(texts)
    # a set: rows that repeat doc_id and text have the same stretches
    runs = runs.groupBy("id", "same").agg(F.collect_set(F.struct("first", "runs")).alias("runs"))
    marks = runs.join(copied.withColumn("copied", F.lit(True)), ["id", "same"], "full_outer").toDF(id_, same, runs_, copied_)
    out = keyed.join(marks, [id_, same], "left").select(*[F.col(f"`{c}`") for c in docs.columns], runs_, F.coalesce(copied_, F.lit(False)).alias(copied_))
    return out, runs_, copied_


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    prepare(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return _with_runs(docs)[0].select("doc_id", "text", "runs", "copied").mapInArrow(_remove, KEPT)


def stripped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns, whatever their names) with what is left of the texts. A character that
    loses some of its bytes goes. A null text stays null."""
    prepare(docs.sparkSession)
    names, docs = docs.columns, undotted(docs)
    out, runs, copied = _with_runs(docs)
    return out.mapInArrow(_strip(docs.columns, runs, copied), docs.schema).toDF(*names)
