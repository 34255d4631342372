"""MinHash near-dedup by SuperMinHash: signatures, banding, verification on full shingle sets, union-find grouping.

A text's elements each bring a random permutation of the signature's places and a rank for each step of it; a place
keeps the least rank plus step. Steps run for all elements of a batch at once and stop for a text as soon as no later
step can lower any of its places, so long texts need one or two steps an element.

Texts with equal sets are one class; signatures are banded for one of each class. In a band's bucket everyone is first
checked against the bucket's least member. Buckets whose members are then in one component are settled. In the others
all members in different components are checked on their full sets within a task, in blocks where a bucket is large:
no link that banding finds is lost, and pairs are never listed.

Nulls and edge cases: null or empty texts have empty sets and link with nothing; rows with the same doc_id are one
node; a row with a null doc_id links like others, also as the only link between two, but a component is named by the
doc_ids in it (null, and kept, where none has one); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import discard, prepare, release, utf8, written
from paperloom.llm.components import HELD, components, forest, stars
from paperloom.llm.shingles import mix, shingle_sets

#: Places of a signature and bands: a pair of similarity 0.75 misses all 32 bands of 4 with probability 5e-6.
PLACES, BANDS = 128, 32
#: Elements whose permutations are held at once; members of a block; elements of a matrix product's slice.
ELEMENTS, BLOCK, SLICE = 50_000, 256, 8192
_U = np.uint64
_SCALE = 2.0**-53


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places) of sets of 64-bit hashes; a place without any element holds infinity."""
    out = np.full((len(sets), places), np.inf)
    at = 0
    while at < len(sets):
        stop, total = at, 0
        while stop < len(sets) and (stop == at or total + len(sets[stop]) <= ELEMENTS):
            total += len(sets[stop])
            stop += 1
        for lo in range(0, max((len(s) for s in sets[at:stop]), default=0), ELEMENTS):  # a longer text goes in turns
            _steps(out[at:stop], [s[lo : lo + ELEMENTS] for s in sets[at:stop]], places)
        at = stop
    return out


def _steps(sig: np.ndarray, sets: list[np.ndarray], places: int) -> None:
    seed = np.concatenate(sets)
    text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = None
    for step in range(places):
        if step:
            open_ = sig.max(axis=1) >= step
            keep = open_[text]
            if order is None:
                seed, text, pick = seed[keep], text[keep], pick[keep]
                order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(seed), 1))
                rows = np.arange(len(seed))
                order[rows, pick] = 0  # place 0 went where the first step took its place from
            elif not keep.all():
                seed, text, order = seed[keep], text[keep], order[keep]
            if not len(seed):
                return
        draw = mix(seed + _U((2 * step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank = (draw >> _U(11)).astype(np.float64) * _SCALE + step
        pick = step + (mix(draw ^ _U(0xD1B54A32D192ED03)) % _U(places - step)).astype(np.int64)
        if order is None:
            place = pick
        else:
            rows = np.arange(len(seed))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[rows, step]
        np.minimum.at(sig.reshape(-1), text * places + place, rank)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each text and band; keys of different bands differ."""
    parts = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, -1)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), 1))
    for i in range(parts.shape[2]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set), keys (one a band; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sets = shingle_sets(*utf8(b.column("text")))
            keys = band_keys(super_minhash(sets, places), bands)
            size = np.array([len(s) for s in sets], np.int64)
            flat = pa.array(keys[size > 0].ravel(), pa.int64())
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), _digests(sets), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "n", "digest", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>")


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        sets = shingle_sets(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "elements"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        sets = shingle_sets(*utf8(b.column("text")))
        yield pa.RecordBatch.from_arrays([_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "elements"])


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (id, elements) are similar."""
    both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the left has in common with each of the right: a product of 0/1 matrices over
    the elements that both sides have, a slice of them at a time."""
    n_left, n_right = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out
    sides = []
    for values, sizes in ((a, n_left), (b, n_right)):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]))
    for lo in range(0, len(common), SLICE):
        marks = []
        for (row, at), n in zip(sides, (len(left), len(right))):
            here = (at >= lo) & (at < lo + SLICE)
            m = np.zeros((n, min(SLICE, len(common) - lo)), np.float32)
            m[row[here], at[here] - lo] = 1
            marks.append(m)
        out += marks[0] @ marks[1].T
    return out


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """rows: mine, other, root, elements of a pair of blocks. A forest of the links across components, by their roots."""
    first = min(r[0] for r in rows)
    left = [r for r in rows if r[0] == first]
    right = [r for r in rows if r[0] != first] if rows[0][0] != rows[0][1] else left
    if not left or not right:
        return []
    x, y = ([np.frombuffer(r[3], np.uint64) for r in side] for side in (left, right))
    inter = shared_counts(x, y).astype(np.int64)
    total = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
    apart = np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])[None, :]
    i, j = np.nonzero(apart & (100 * inter >= percent * (total - inter)))
    return forest([(left[p][2], right[q][2]) for p, q in zip(i.tolist(), j.tolist())])


def _across(percent: int):
    """Rows come by pair of blocks; one is in memory at a time, and a bounded number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows: list[tuple] = []
        last, found = None, []
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("key", "x", "y", "mine", "other", "root", "elements"))
            for key, x, y, *row in zip(*columns):
                if (key, x, y) != last:
                    if rows:
                        found += _block_links(rows, percent)
                    last, rows = (key, x, y), []
                    if len(found) > HELD:
                        yield stars(forest(found))
                        found = []
                rows.append(tuple(row))
        if rows:
            found += _block_links(rows, percent)
        yield stars(forest(found))

    return run


def links_across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rest: key, size, id, root of the members of buckets that hold several components. Links between different
    components, by their roots, as a forest. A bucket is dealt in blocks and each pair of blocks is a key of its own, so that a large
    bucket is spread over many tasks; members travel with their sets, and no pair of them is listed."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(sets, "id").select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "other", "root", "elements")
    spread = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(spread, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_across(percent), "a long, b long")


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_shingles, component_id, kept, one row a row of docs."""
    spark = prepare(docs.sparkSession)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sigs = written(signatures(docs), "signatures")
    count, with_id, highest = sigs.agg(F.count("*"), F.count("doc_id"), F.coalesce(F.max("doc_id"), F.lit(0))).first()  # of file footers; bounds what follows
    highest = max(highest, 0)
    if with_id < count and highest >= 1 << 62:
        raise ValueError("doc_ids leave no room to number rows without one")
    classes = sigs.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.min("keys").alias("keys"))
    # classes without any doc_id are numbered beyond all doc_ids, so that one never is the least of a component with some
    classes = written(classes.withColumn("rep", F.coalesce("rep", F.lit(highest + 1) + F.monotonically_increasing_id())), "classes", rows=count)
    rows = classes.select(F.explode("keys").alias("key"), F.col("rep").alias("id"), "n")
    # written, so that both sides of the join are plain shuffles, of which a hot bucket's can be split
    hubs = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.max("id").alias("top"), F.count("*").alias("size")).filter("hub.id <> top")
    hubs = written(hubs, "hubs", rows=count)  # a bucket has two members at least, so half of the bands' rows at most
    members = written(rows.join(hubs, "key").select("key", "size", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "members", rows=count)
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(members.select("id").distinct(), "id").withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])
    elements = texts.select("id", "text").mapInArrow(_sets, "id long, elements binary")
    if with_id < count:  # one text of each class without a doc_id is found by its digest
        unnamed = docs.filter("doc_id is null").select("text").mapInArrow(_digested, "digest binary, elements binary").groupBy("digest").agg(F.first("elements").alias("elements"))
        unnamed = unnamed.join(classes.filter(F.col("rep") > highest).select("digest", F.col("rep").alias("id")), "digest").join(members.select("id").distinct(), "id")
        elements = elements.unionByName(unnamed.select("id", "elements"))
    sets = written(elements, "sets", rows=count)
    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    star = members.filter("id <> hub").filter(fits).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = written(verified(star, sets, percent), "links", rows=count, dealt=True)
    roots = components(links)

    # buckets that still hold several components
    known = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "size", "id", F.coalesce("root", "id").alias("root"))
    known = written(known, "known", rows=count)
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = written(mixed, "mixed", rows=count)
    more = written(links_across(known.join(mixed, "key"), sets, percent), "links", rows=count, dealt=True)
    discard(hubs, members, sets, links, known, mixed)
    again = components(more)  # of components; few are left to be joined
    discard(more)

    named = sigs.join(classes.select("digest", "rep"), "digest", "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = named.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    out = out.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    component = F.coalesce("top", "root")
    component = F.when(component <= highest, component)  # beyond: a component without any doc_id
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
