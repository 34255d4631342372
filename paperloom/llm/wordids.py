"""Token ids of whole texts with the tokenizers library, at the speed of a dictionary.

Byte-level BPE never merges across the matches of its word pattern, so the ids of a text are the ids of its matches
one after the other. Each distinct match is given to the library once per cache; texts are put together from there.

Added tokens that a text spells out, such as "<|endoftext|>", get their one id, as in the library's encoding with the file
as loaded and add_special_tokens=False: a text is cut at them first, and what lies between is cut into words by itself.
Texts with a token that also asks for its surroundings (whole words only, or white space taken in) go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from itertools import compress

from paperloom.llm.common import held, segments
from paperloom.llm.pieces import finder


def _any(tokens: Iterable[str]) -> re.Pattern | None:
    """Finds the first of the tokens, the longest where several begin."""
    found = sorted(filter(None, tokens), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, found))})") if found else None


class WordIds:
    """Little-endian unsigned 32-bit ids of texts. limit: words kept in the cache, which bounds its memory."""

    def __init__(self, path: str, pattern: str, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.loaded = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # words are no special tokens, whatever they look like together
        for tok in (self.tok, self.loaded):
            tok.no_truncation()
            tok.no_padding()
        added = self.loaded.get_added_tokens_decoder().items()
        plain = {t.content: array("I", [i]).tobytes() for i, t in added if not (t.single_word or t.lstrip or t.rstrip)}
        self.added, self.cut = plain, _any(plain)
        self.odd = _any(t.content for _, t in added if t.content not in plain)
        self.find = finder(pattern)
        self.cache: dict[str, bytes] = {}
        self.limit = limit
        self.heads = [False] * self.tok.get_vocab_size()
        for token, i in self.tok.get_vocab().items():
            self.heads[i] = token[0] == "\u0120"  # how byte-level vocabularies write a space

    def __call__(self, text: str) -> bytes:
        if self.odd and self.odd.search(text):
            return array("I", self.loaded.encode(text, add_special_tokens=False).ids).tobytes()
        if not self.cut or not self.cut.search(text):
            return self._words(text)
        # the pattern's group puts the tokens at odd places
        return b"".join([self.added[x] if i % 2 else self._words(x) for i, x in enumerate(self.cut.split(text)) if x])

    def _words(self, text: str) -> bytes:
        return b"".join([self._part(x) for x in segments(text)])

    def _part(self, text: str) -> bytes:
        words, cache = self.find(text), self.cache
        new = list(set(words).difference(cache))
        if new:
            if len(cache) > self.limit:
                cache.clear()
                new = list(set(words))
            self._learn(new)
        return b"".join(map(cache.__getitem__, words))

    def _learn(self, new: list[str]) -> None:
        """Encode distinct matches. Those that are a space and letters stay matches when put one after the other, so
        many of them go to the library as one text; a token that begins with a space begins a match."""
        plain, single = [], []
        for w in new:
            (plain if w[0] == " " and w[1:].isalpha() else single).append(w)
        runs = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        for at in range(0, len(runs), 100):
            some = runs[at : at + 100]
            for run, e in zip(some, self.tok.encode_batch_fast(["".join(r) for r in some], add_special_tokens=False)):
                got = array("I", e.ids)
                ids, starts = got.tobytes(), list(compress(range(0, 4 * len(got), 4), map(self.heads.__getitem__, got)))
                if len(starts) != len(run):
                    raise ValueError("the library cuts words in another way than the pattern")
                self.cache.update(zip(run, map(ids.__getitem__, map(slice, starts, [*starts[1:], len(ids)]))))
        for at in range(0, len(single), 20_000):
            part = single[at : at + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[w] = array("I", e.ids).tobytes()

    @property
    def vocab_size(self) -> int:
        return self.tok.get_vocab_size()


def load(path: str, pattern: str) -> WordIds:
    """One per worker process and file."""
    return held((WordIds, path, pattern), lambda: WordIds(path, pattern))
