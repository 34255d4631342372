"""Benchmark decontamination by a distributed positional inverted index.

Training texts are indexed where they are: a task takes a batch of texts as a block, and stores for each term the places
where it stands in the block, in ascending order. A block has texts, or parts of a very long text, one after the other
with gaps, so no phrase runs over an end. The index is a table in the shared folder, one row a block; nothing is
shuffled to build it, so a frequent word, a frequent passage or a hot source costs no task more than its own texts.
Where the test's words are at most VOCABULARY, only their places are stored.

Test items are cut into windows of words. The index says how often each term stands in the corpus, and a window's terms
are asked for from the rarest on: its list of places, less the term's offset in the window, gives the starts that are
possible; each further term's list, less its own offset, is intersected with those that are left, by binary search in the
block's sorted (term, place) pairs, for all windows of the test at once. What is left are exact phrases. With a slack, a
further term may stand so many words beside its place: proximity matches. Windows with a term that the corpus, or the
block, doesn't have are dropped before.

Windows go to the workers in parts of about WINDOWS (dealt by hash of distinct window and item), one pass over the index a part: the
bound of what is sent. A pass gives a row for each text with a match; the parts of a text meet by its row's number.

Nulls and edge cases: null or wordless texts have no words and match nothing; rows that repeat a doc_id, or have none,
are each a document; a null item's windows count as hits but have no item_id to list; a repeated item_id is one item;
items with fewer words than a window are one window, those without words none; empty tables give no rows, or no hits;
very long texts are indexed in parts that overlap; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, release, utf8, written
from paperloom.llm.shingles import words

#: Words of a window; words that a proximity match's terms may be off.
WINDOW, NEAR = 10, 2
#: Distinct words of the test up to which only their places are indexed, and windows of a pass.
VOCABULARY, WINDOWS = 1 << 20, 1 << 17
#: Words of a block's part of a text, places between parts (so also how far parts of one text overlap, which is more than
#: a window and its slack), starts that are looked at together.
PART, GAP, STARTS = 1 << 19, 64, 1 << 19
#: A block's pairs of term and place are single numbers: places are below this.
PLACES = 1 << 32
#: Bytes that end a word: ASCII but for digits and letters.
GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

BLOCK = "rows array<long>, ids array<long>, starts array<long>, bases array<long>, sizes array<long>, n_words array<long>, terms array<long>, counts array<long>, places binary"


def _parts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of each part; a text of up to PART words, or none, is one part."""
    out = []
    for k, n in enumerate(sizes.tolist()):
        lo = 0
        while True:
            hi = min(n, lo + PART)
            out.append((k, lo, hi - lo))
            if hi == n:
                break
            lo = hi - GAP
    text, start, size = zip(*out) if out else ((), (), ())
    return np.array(text, np.int64), np.array(start, np.int64), np.array(size, np.int64)


def _block(hashes: np.ndarray, where: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, how often each occurs, and the places of all, term by term."""
    if vocabulary is not None:
        if not len(vocabulary):
            return vocabulary, vocabulary, vocabulary
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        known = vocabulary[at] == hashes
        number, where = at[known].astype(np.int32), where[known]
        order = np.argsort(number, kind="stable")
        held = np.bincount(number, minlength=len(vocabulary))
        some = np.flatnonzero(held)
        return vocabulary[some], held[some], where[order]
    order = np.argsort(hashes, kind="stable")
    terms, counts = np.unique(hashes, return_counts=True)
    return terms, counts, where[order]


def _indexed(vocabulary: np.ndarray | None):
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            hashes, first = words(*utf8(b.column("text")), GAPS)
            hashes = hashes.view(np.int64)
            sizes = np.diff(first)
            text, start, size = _parts(sizes)
            base = np.concatenate([[0], np.cumsum(size + GAP)])[:-1]
            rows, ids = b.column("row"), b.column("doc_id")
            lo = 0
            while lo < len(text):  # parts in a block as long as they fit
                hi = max(lo + 1, int(np.searchsorted(base, base[lo] + 2 * PART)))
                n = size[lo:hi]
                each = np.repeat(np.arange(lo, hi), n)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                terms, counts, places = _block(hashes[first[text[each]] + start[each] + inside], base[each] - base[lo] + inside, vocabulary)
                of = pa.array(text[lo:hi])
                lists = [rows.take(of), ids.take(of), *map(pa.array, (start[lo:hi], base[lo:hi] - base[lo], n, sizes[text[lo:hi]], terms, counts))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([places.astype(np.int32).tobytes()], pa.binary())], names)
                lo = hi

    return run


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text. The positional index as a written table; terms: one column of term hashes, if only their places are
    to be stored (for at most VOCABULARY of them; beyond, all words' places are)."""
    spark = prepare(docs.sparkSession)
    vocabulary = None
    if terms is not None:
        some = terms.distinct().limit(VOCABULARY + 1).toArrow().column(0).to_numpy().astype(np.int64)
        vocabulary = np.sort(some) if len(some) <= VOCABULARY else None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_indexed(vocabulary), BLOCK), "positions", "zstd")


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            hashes, first = words(*utf8(b.column("text")), GAPS)
            hashes = hashes.view(np.int64)
            for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                size = min(n, hi - lo)
                if size:
                    rows = np.lib.stride_tricks.sliding_window_view(hashes[lo:hi], size)
                    flat = pa.array(rows.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), flat)
                    yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(np.full(len(rows), k))), lists], ["item_id", "terms"])

    return run


def windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """items: item_id, text. Distinct item_id, terms (hashes of n words on end, or of all where there are fewer)."""
    prepare(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_windows(n), "item_id string, terms array<long>").distinct(), "windows")


def rarest_first(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """asked: item_id, terms. The windows all of whose terms the corpus has, with offsets: their terms in order of how
    often they occur in it, and equally frequent ones as in the window."""
    counts = indexed.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))
    # written, so that both sides of the join are plain shuffles, of which a frequent term's can be split
    counts = written(counts, "term-counts", rows=VOCABULARY)
    each = asked.withColumn("window", F.monotonically_increasing_id()).select("window", "item_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    lists = each.join(counts, "term").groupBy("window").agg(F.first("item_id").alias("item_id"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("t"))
    return lists.filter(F.size("t") == F.col("size")).select("item_id", F.col("t.term").alias("terms"), F.col("t.offset").alias("offsets"))


class Asked:
    """Windows on a worker, by size: items, and terms and offsets as matrices."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.items = np.array(rows.column("item_id").to_pylist(), object)
        sizes = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        self.groups = []
        for k in np.unique(sizes):
            at = np.flatnonzero(sizes == k)
            take = lambda c: np.asarray(rows.column(c).combine_chunks().take(pa.array(at)).flatten()).reshape(-1, k)  # noqa: E731, B023
            self.groups.append((at, take("terms").astype(np.int64), take("offsets").astype(np.int64)))

    def matches(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, slack: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Windows, the places in the block at which they start, and their size."""
        if not len(terms):
            return
        ends = np.cumsum(counts)
        pairs = np.repeat(np.arange(len(terms), dtype=np.int64) * PLACES, counts) + places
        for at, wanted, offsets in self.groups:
            number = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
            here = np.flatnonzero((terms[number] == wanted).all(axis=1))
            lengths = counts[number[here, 0]]
            after = np.cumsum(lengths)
            lo = 0
            while lo < len(here):
                hi = max(lo + 1, int(np.searchsorted(after, after[lo] - lengths[lo] + STARTS, "right")))
                some, n = here[lo:hi], lengths[lo:hi]
                row = np.repeat(some, n)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = places[(ends - counts)[number[row, 0]] + inside] - offsets[row, 0]
                for r in range(1, wanted.shape[1]):
                    pair = number[row, r] * PLACES + start + offsets[row, r]
                    found = np.minimum(np.searchsorted(pairs, pair - slack), len(pairs) - 1)
                    kept = (pairs[found] >= pair - slack) & (pairs[found] <= pair + slack)
                    row, start = row[kept], start[kept]
                    if not len(row):
                        break
                if len(row):
                    yield at[row], start, wanted.shape[1]
                lo = hi


def _runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of places that are covered."""
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], np.maximum.accumulate((start + size)[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], hi[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(lo) - 1]])]


def _searched(asked: Asked, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for k in range(b.num_rows):
                one = {c: b.column(c)[k].values.to_numpy() for c in ("rows", "starts", "bases", "sizes", "terms", "counts")}
                places = np.frombuffer(b.column("places")[k].as_py(), np.int32).astype(np.int64)
                got = list(asked.matches(one["terms"], one["counts"], places, slack))
                if not got:
                    continue
                window, start = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                size = np.concatenate([np.full(len(g[0]), g[2]) for g in got])
                part = np.clip(np.searchsorted(one["bases"], start, "right") - 1, 0, None)
                rows, spans, items = [], [], []
                order = np.argsort(part, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    p = part[some[0]]
                    lo, hi = _runs(start[some] - one["bases"][p], size[some])
                    if slack:  # a place beside may be outside of the part
                        lo, hi = np.clip(lo, 0, one["sizes"][p]), np.clip(hi, 0, one["sizes"][p])
                    rows.append(int(one["rows"][p]))
                    spans.append([{"lo": x, "hi": y} for x, y in zip((lo + one["starts"][p]).tolist(), (hi + one["starts"][p]).tolist())])
                    items.append(list({asked.items[w] for w in np.unique(window[some]).tolist()} - {None}))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(items, pa.list_(pa.string()))], ["row", "spans", "items"])

    return run


def search(indexed: DataFrame, asked: DataFrame, slack: int = 0, at_once: int = WINDOWS) -> DataFrame:
    """Where the windows (item_id, terms) occur: row, spans (maximal runs of words that are hit, as lo and hi), items. A row
    for each text, or part of a text, with a match and pass. With a slack, spans are where the windows would stand."""
    ordered = written(rarest_first(asked, indexed), "asked")
    passes = max(1, -(-ordered.count() // at_once))
    out = None
    for k in range(passes):
        some = ordered.filter(F.pmod(F.xxhash64("item_id", "terms", "offsets"), F.lit(passes)) == k)
        found = indexed.mapInArrow(_searched(Asked(some.toArrow()), slack), "row long, spans array<struct<lo:long,hi:long>>, items array<string>")
        out = found if out is None else out.unionByName(found)
    discard(ordered)
    return out


def _covered(spans: str):
    """Words in the union of spans."""
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["hi"] - F.greatest(x["lo"], s["end"]))).alias("n"), F.greatest(s["end"], x["hi"]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda s: s["n"])


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row a document: doc_id, n_words, spans (of words, which may overlap), items (that occur), near_items (that occur with
    every word of a window within `near` words of its place, seen from the window's rarest word)."""
    if window + near > GAP:
        raise ValueError(f"a window and its slack have {GAP} words at most")
    asked = windows(items, window)
    indexed = index(docs, asked.select(F.explode("terms")))
    of = F.explode(F.arrays_zip("rows", "ids", "n_words", "starts")).alias("d")
    every = indexed.select(of).filter("d.starts = 0").select(F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    exact = search(indexed, asked)
    beside = search(indexed, asked, near).select("row", F.col("items").alias("near_items"))
    rows = every.unionByName(exact, True).unionByName(beside, True)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")]
    out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists)
    distinct = {c: F.array_sort(F.array_distinct(c)) for c in ("items", "near_items")}
    out = written(out.drop("row").withColumns(distinct), "matched")
    discard(asked, indexed)
    return out


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    n_near."""
    found = matched(docs, items, window).withColumn("n_hit", _covered("spans"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))
