"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each place of a word; dynamic programming carries
the best score and the number of pieces, no path. Tie rules are those of the tokenizers library's Unigram model with
Metaspace pre-tokenization: of equal scores the piece that starts first wins; a character that is no piece of its own
costs the lowest score less 10; it counts as its bytes where the vocabulary has all byte pieces, else a run of such
characters counts as one. Texts are cut where Metaspace cuts them, so a distinct word is worked out once per cache.

Nulls and edge cases: a null or empty text has 0 tokens; a very long word needs memory for max_piece places only;
repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import held, prepare, strings

SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in id order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class UnigramCounter:
    """limit: words kept in the cache."""

    def __init__(self, pieces: list[tuple[str, float]], limit: int = 500_000):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        known = {p for p, _ in pieces}
        self.single = {p for p in known if len(p) == 1}
        self.by_bytes = all(f"<0x{i:02X}>" in known for i in range(256))
        self.unknown = min(s for _, s in pieces) - 10
        self.span = max(len(p) for p, _ in pieces) + 1
        # where no piece holds a line feed, the text falls apart there: the sides' best paths don't depend on each other
        self.feed_cost = 1 if self.by_bytes and not any("\n" in p for p in known) and all(s.is_integer() for _, s in pieces) else None
        self.cache: dict[str, int] = {}
        self.limit = limit

    def word(self, word: str) -> int:
        """Pieces of the best path through one word."""
        n, span, single, by_bytes = len(word), self.span, self.single, self.by_bytes
        if not n:
            return 0
        score, count, loose = [0.0] * span, [0] * span, [False] * span  # by end modulo span; loose: ends in an unknown
        found, item = self.auto.iter(word), None
        item = next(found, None)
        for end in range(1, n + 1):
            best, pieces, open_ = None, 0, False
            while item is not None and item[0] == end - 1:  # the longest, which starts first, comes first
                length, s = item[1]
                at = (end - length) % span
                if best is None or score[at] + s > best:
                    best, pieces, open_ = score[at] + s, count[at] + 1, False
                item = next(found, None)
            if (c := word[end - 1]) not in single:
                at = (end - 1) % span
                if best is None or score[at] + self.unknown > best:
                    best, open_ = score[at] + self.unknown, True
                    pieces = count[at] + (len(c.encode()) if by_bytes else not loose[at])
            at = end % span
            score[at], count[at], loose[at] = best, pieces, open_
        return count[n % span]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if text[0] != SPACE:
            text = SPACE + text
        return self._sum(text.split(SPACE)[1:])

    def _sum(self, words: list[str]) -> int:
        cache = self.cache
        if new := set(words).difference(cache):
            if len(cache) > self.limit:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = self._cut(w)
        return sum(map(cache.__getitem__, words))

    def _cut(self, word: str) -> int:
        """A word, without its mark. Its lines are worked out one by one where the vocabulary allows it."""
        if not self.feed_cost or "\n" not in word:
            return self.word(SPACE + word)
        first, *rest = word.split("\n")
        cache = self.cache
        total = len(rest) * self.feed_cost + (cache[first] if first in cache else self.word(SPACE + first))
        return total + sum(self.word(x) for x in rest)


def load(path: str) -> UnigramCounter:
    return held((UnigramCounter, path), lambda: UnigramCounter(vocabulary(path)))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of each whole text. path: a sentencepiece file whose
    pieces and scores make the unigram vocabulary."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([counter.count(t) for t in strings(b.column("text"))], pa.int64())], ["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long")
