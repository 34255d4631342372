"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut into the matches of the pattern, and each match into halves, down to single bytes, which are tokens.
Neighbours are joined up the tree: the last tokens of the left and the first of the right are encoded again as one
window. The join is done when the window's outer tokens and the tokens beside them, taken as pairs, encode to
themselves: a sequence of tokens is the encoding of its bytes exactly if that holds for every pair of neighbours, so
what lies outside the window can't change any more. Otherwise the window grows. Between matches no merge is possible, so
there nodes are joined by concatenation alone, FAN at a time. Decoding concatenates up the same kind of tree, from a
text's ids. Subtrees that come again (short ones, whole matches) are kept, windows and pairs of tokens likewise.

Nulls and edge cases: a null text counts as empty and has no tokens; very long matches take n log n steps and very long
texts are worked off in segments; repeated rows each give a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import held, prepare, segments, strings
from paperloom.llm.pieces import finder

#: Nodes that are concatenated at once; bytes of a subtree that is kept; bytes of a window merged without a heap.
FAN, SUBTREE, DIRECT = 64, 8, 64


class ByteBPE:
    """ranks: each token's bytes and rank; pattern: what cuts texts into matches. limit bounds each cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 250_000):
        self.ranks, self.limit = ranks, limit
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.names = {v: str(v) for v in self.bytes_of}
        self.find = finder(pattern)
        self.leaves = {bytes([i]): (ranks[bytes([i])],) for i in range(256)}
        self.nodes: dict[bytes, tuple[int, ...]] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.matches: dict[str, bytes] = {}
        #: Nodes that were joined within matches, and of those the joins that had to let their window grow.
        self.joins = self.grown = 0

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Merge the pair of the lowest rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if len(data) > DIRECT:
            return self._merge_heap(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_heap(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def window(self, data: bytes) -> tuple[int, ...]:
        if (got := self.windows.get(data)) is None:
            got = self.merge(data)
            if len(data) <= DIRECT:
                if len(self.windows) > self.limit:
                    self.windows.clear()
                self.windows[data] = got
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side encode to themselves."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.limit:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded neighbours within a match."""
        self.joins += 1
        bytes_of, n, m, i, j = self.bytes_of, len(left), len(right), 1, 1
        middle = self.window(bytes_of[left[-1]] + bytes_of[right[0]])
        while True:
            left_ok = i == n or self.stable(left[-i - 1], middle[0])
            right_ok = j == m or self.stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: n - i] + middle + right[j:]
            self.grown += 1
            i, j = i if left_ok else min(n, 2 * i), j if right_ok else min(m, 2 * j)
            middle = self.window(b"".join(map(bytes_of.__getitem__, left[n - i :] + right[:j])))

    def node(self, data: bytes) -> tuple[int, ...]:
        """The encoding of some bytes of a match: its halves' encodings, joined."""
        n = len(data)
        if n == 1:
            return self.leaves[data]
        if n > SUBTREE:
            return self.join(self.node(data[: n // 2]), self.node(data[n // 2 :]))
        if (got := self.nodes.get(data)) is None:
            got = self.join(self.node(data[: n // 2]), self.node(data[n // 2 :]))
            if len(self.nodes) > self.limit:
                self.nodes.clear()
            self.nodes[data] = got
        return got

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match. One that is a token as a whole is that token, whether merges lead to it or not."""
        ids = self.node(data)
        if len(ids) > 1 and (rank := self.ranks.get(data)) is not None:
            return (rank,)
        return ids

    def _reduced(self, text: str) -> bytes:
        """Ids of a segment, as unsigned 32-bit numbers: its matches' nodes, concatenated up the tree."""
        words, known = self.find(text), self.matches
        if new := set(words).difference(known):
            if len(known) > self.limit:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = np.array(self.piece(w.encode()), "<u4").tobytes()
        return concatenated(list(map(known.__getitem__, words)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(concatenated([self._reduced(x) for x in segments(text)]), "<u4").tolist() if text else []

    def decode(self, ids: list[int]) -> bytes:
        return concatenated(list(map(self.bytes_of.__getitem__, ids)))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, sha256 of their decimals joined by a space, sha256 of the bytes that they decode to. A long
        text goes segment by segment."""
        ids_hash, out_hash, n = hashlib.sha256(), hashlib.sha256(), 0
        for part in segments(text):
            ids = np.frombuffer(self._reduced(part), "<u4").tolist()
            if ids:
                ids_hash.update(b" " if n else b"")
                ids_hash.update(" ".join(map(self.names.__getitem__, ids)).encode())
                out_hash.update(self.decode(ids))
                n += len(ids)
        return n, ids_hash.hexdigest(), out_hash.hexdigest()


def concatenated(nodes: list[bytes]) -> bytes:
    """A reduction tree of concatenations, FAN nodes at a time."""
    while len(nodes) > FAN:
        nodes = [b"".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
    return b"".join(nodes)


def load(path: str, pattern: str) -> ByteBPE:
    return held((ByteBPE, path, pattern), lambda: ByteBPE.from_file(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of each text: doc_id, ids."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.encode(t) for t in strings(b.column("text"))], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of each row of ids (null: no ids): doc_id, data."""
    prepare(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return ids.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each whole text, decode the ids, and return doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            n, ids, out = zip(*map(bpe.digest, strings(b.column("text")))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
