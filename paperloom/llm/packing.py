"""Best-fit packing with bound-certified repacking.

Documents become ids of a tokenizer plus an end id; documents longer than a sequence are cut into pieces. Pieces are
dealt to groups of bounded size, each packed by best fit decreasing. Dual feasible functions give a lower bound of the
sequences that a group's pieces need. A group whose count meets the bound is certified. One with a gap is packed again:
each sequence begins with the longest piece left, then pieces of random lengths follow while more than one fits, and
the last is the one that fits best; of some tries the fewest sequences count.

Then groups exchange pieces: those of all sequences with room in groups with a gap, and of a certified group's emptiest
ones (as many as have one sequence's room together, for bounds are rounded up), are dealt to new groups and packed
again. Rounds end when the whole table's count meets the whole table's bound, when one group has taken all, or
when IDLE rounds in a row, each with groups of twice the size, neither saved a sequence nor closed one. A group's pieces
are numbers, and at most about GROUP_PIECES times 2 to the power IDLE.

Nulls and edge cases: a null or empty text is the end id alone; an empty table gives no rows; repeated rows are packed
each; other columns are ignored; pieces of equal length are taken in doc_id order, nulls first.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import wordids
from paperloom.llm.common import discard, prepare, strings, written

#: Pieces of a group, about; rounds without a gain that end the exchange.
GROUP_PIECES, IDLE = 40_000, 3
#: Random lengths that are tried for a piece in the middle of a sequence, one number a repacking of a group with a gap.
TRIES = (4, 16, 64)
#: Pieces up to which a group with a gap is packed exactly.
EXACT = 12

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = f"grp long, {PIECE}, sequence_id long, offset int, open boolean, used long, bound long"


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, size: int) -> DataFrame:
    """Each document's pieces of at most size ids; the first holds what is left over."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = wordids.load(tokenizer, pattern)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
                ids = encode(text) + end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                rows += [(doc_id, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    return counted_bound(np.bincount(lengths, minlength=size + 1), size)


def counted_bound(count: np.ndarray, size: int) -> int:
    """count: how many pieces have each length, 0 to size. The largest bound that two families of dual feasible
    functions give, in whole numbers.

    The first, for each threshold e up to size/2: lengths over size - e count as size, those under e as nothing, others
    as they are. The second, for k = 1..32: x counts floor((k + 1) x / size) / k, or x / size where that product is
    whole. Without a threshold (e = 0) the first gives the sum over the size."""
    count = np.asarray(count, np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    many, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * x)])
    e = np.arange(size // 2 + 1)
    first = many[-1] - many[size - e + 1] + -((mass[e] - mass[size - e + 1]) // size)
    best = int(first.max())
    for k in range(1, 33):
        whole = (k + 1) * x % size == 0
        value = np.where(whole, k * x, (k + 1) * x // size * size)  # in units of 1 / (k size)
        best = max(best, int(-(-int((count * value).sum()) // (k * size))))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit of lengths in the given order: each one's bin and place, and the bins' fill. Bins are found by their
    room: one bit says which rooms exist, so the smallest that is large enough is a shift away."""
    bins, place, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    having: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0
    for i, n in enumerate(lengths.tolist()):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = having[room].pop()
            if not having[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], place[i] = b, fill[b]
        fill[b] += n
        if left := room - n:
            having[left].append(b)
            rooms |= 1 << left
    return bins, place, np.array(fill, np.int64)


def refilled(lengths: np.ndarray, size: int, tries: int, seed: int = 5) -> np.ndarray:
    """Bins of lengths: each bin begins with the longest piece left and ends with the one that fits best; between these,
    of some random lengths the one after which the best last piece leaves the least room. Lengths that are left are the
    bits of one number."""
    rng = random.Random(seed)
    having: list[list[int]] = [[] for _ in range(size + 1)]
    for i, n in enumerate(lengths.tolist()):
        having[n].append(i)
    left = sum(1 << n for n, h in enumerate(having) if h)
    bins = np.empty(len(lengths), np.int64)

    def longest(room: int, but: int = 0) -> int:
        """The greatest length left up to room; without one piece of length but; -1 without any."""
        some = left & ~(1 << but) if but and len(having[but]) == 1 else left
        return (some & ((1 << (room + 1)) - 1)).bit_length() - 1

    b = 0
    while left:
        room, n = size, left.bit_length() - 1
        while n > 0:
            bins[having[n].pop()] = b
            if not having[n]:
                left &= ~(1 << n)
            room -= n
            n, least = longest(room), (left & -left).bit_length() - 1
            if n > 0 and room - least >= least:  # two more may fit
                best = size
                for _ in range(tries):
                    a = longest(rng.randint(least, min(n, room - least)))
                    rest = room - a - max(longest(room - a, a), 0)
                    if rest < best:
                        best, choice = rest, a
                    if not rest:
                        break
                n = choice
        b += 1
    return bins


def exact(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bins of a few lengths, as few as can be: over all subsets, the fewest bins and the least fill of the last."""
    n = len(lengths)
    best, last = [(0, 0)] + [(n + 1, 0)] * ((1 << n) - 1), [0] * (1 << n)
    for have in range(1 << n):
        bins, fill = best[have]
        for i in range(n):
            if not have >> i & 1:
                now = (bins, fill + int(lengths[i])) if bins and fill + lengths[i] <= size else (bins + 1, int(lengths[i]))
                if now < best[have | 1 << i]:
                    best[have | 1 << i], last[have | 1 << i] = now, i
    out, have = np.empty(n, np.int64), (1 << n) - 1
    while have:
        out[last[have]] = best[have][0] - 1
        have &= ~(1 << last[have])
    return out


def places(lengths: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's place in its bin, and the bins' fill."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    fill = np.bincount(bins, lengths).astype(np.int64)
    place = np.empty(len(bins), np.int64)
    place[order] = ends - lengths[order] - (np.cumsum(fill) - fill)[bins[order]]
    return place, fill


def fewest(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int, int]:
    """lengths, descending: their bins, how many these are, and how many there must be at least."""
    bins, _, fill = best_fit(lengths, size)
    used, bound = len(fill), lower_bound(lengths, size)
    for tries in TRIES:
        if used == bound:
            break
        again = refilled(lengths, size, tries)
        if again.max() + 1 < used:
            bins, used = again, int(again.max()) + 1
    if used > bound and len(lengths) <= EXACT:
        bins = exact(lengths, size)
        used = int(bins.max()) + 1
    return bins, used, bound


def pack_group(rows: pa.Table, size: int, tag: int, last: bool) -> pa.Table:
    """Pack one group; mark the sequences to pass on as open."""
    rows = rows.take(pc.sort_indices(rows, [("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32"))], null_placement="at_start"))
    lengths = rows.column("length").to_numpy()
    bins, used, bound = fewest(lengths, size)
    place, fill = places(lengths, bins)
    open_ = np.zeros(used, bool)
    if not last:
        loose = np.flatnonzero(fill < size)
        if used == bound:
            loose = loose[np.argsort(fill[loose], kind="stable")]
            loose = loose[: 1 + np.searchsorted(np.cumsum(size - fill[loose]), size)]
        open_[loose] = True
    group, n = rows.column("grp")[0].as_py(), rows.num_rows
    new = {
        "sequence_id": pa.array((tag << 56) + (group << 24) + bins, pa.int64()),
        "offset": pa.array(place, pa.int32()),
        "open": pa.array(open_[bins]),
        "used": pa.array([used] * n, pa.int64()),
        "bound": pa.array([bound] * n, pa.int64()),
    }
    for name, values in new.items():
        rows = rows.append_column(name, values)
    return rows


def _packer(size: int, tag: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        return pack_group(rows, size, tag, last)

    return run


def bound_of(pieces_: DataFrame, size: int) -> int:
    """The lower bound of a whole table's sequences, from the number of pieces of each length: size rows at most."""
    count = np.zeros(size + 1, np.int64)
    for length, n in pieces_.groupBy("length").count().collect():
        count[length] = n
    return counted_bound(count, size)


def dealt(pieces_: DataFrame, tag: int, groups: int) -> DataFrame:
    """Written pieces with a group each, another one at each tag. A piece's place in the table is part of what decides, so
    that rows which repeat each other in all columns are spread like others."""
    return pieces_.withColumn("grp", F.pmod(F.xxhash64(F.lit(tag), "doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))


def pack(pieces_: DataFrame, size: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack pieces (PIECE) into sequences of size: the pieces with sequence_id, offset, and the sequences that the group
    in which theirs was closed used and needed at least (used, bound; certified where they are equal)."""
    columns = [c.split()[0] for c in PIECE.split(", ")]
    table = written(pieces_, "pieces")
    n, least = table.count(), bound_of(table, size)
    now, done, closed, tag, before, idle = table, [], 0, 0, None, 0
    while True:
        groups = max(1, -(-n // (group_pieces << idle)))
        placed = dealt(now, tag, groups).select("grp", *columns).groupBy("grp").applyInArrow(_packer(size, tag, groups == 1), PLACED)
        placed = written(placed, f"packed{tag}", rows=n)
        first = F.col("offset") == 0
        n, open_, shut = placed.agg(F.count_if("open"), F.count_if(F.col("open") & first), F.count_if(~F.col("open") & first)).first()
        idle = idle + 1 if (n, open_ + shut) == before else 0
        # the end: all taken, as few as can be, or nothing gained
        if not n or closed + open_ + shut == least or idle == IDLE:
            done.append(placed)
            break
        done.append(placed.filter("not open"))
        now, closed, before, tag = placed.filter("open"), closed + shut, (n, open_), tag + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    discard(table)
    return out.selectExpr("doc_id", "piece", "start", "cast(length as long) length", "ids_crc32", "sequence_id", "cast(offset as long) offset", "used", "bound")


def packed(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 0, size: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, pattern, end_id, size), size)
