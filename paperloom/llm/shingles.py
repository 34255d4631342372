"""Word shingles of whole texts as 64-bit hashes, in numpy over a batch's bytes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = 0xD6E8FEB86659FD93 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that are hashed at once.
SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, SPAN + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _hash_words(part: np.ndarray, breaks: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; a word also ends at breaks (places in part)."""
    word = ~gaps[part]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(part))]
    starts[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(part) + 1)
    sums = np.empty(len(part) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[part] * power[:-1], out=sums[1:])
    return at, mix((sums[to] - sums[at]) * inverse[at] + (to - at).astype(np.uint64) * _U(0xA0761D6478BD642F))


def words(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and each text's first place in them. gaps: which bytes end words."""
    at, hashes, lo = [], [], 0
    while lo < len(buf):
        hi = min(len(buf), lo + SPAN)
        if hi < len(buf):  # cut between texts or at white space
            stops = off[np.searchsorted(off, lo, "right") : np.searchsorted(off, hi, "right")]
            if len(stops):
                hi = int(stops[-1])
            else:
                step = SPAN
                while hi < len(buf):
                    space = np.flatnonzero(gaps[buf[hi : hi + step]])
                    if len(space):
                        hi += int(space[0])
                        break
                    hi += step
                hi = min(hi, len(buf), int(off[np.searchsorted(off, lo, "right")]))
        a, h = _hash_words(buf[lo:hi], off[(off > lo) & (off < hi)] - lo, gaps)
        at.append(a + lo)
        hashes.append(h)
        lo = hi
    at_, h_ = (np.concatenate(at), np.concatenate(hashes)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return h_, np.searchsorted(at_, off)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of k lower-cased words; of fewer words, the whole sequence as one."""
    w, first = words(buf, off)
    n = len(w)
    full = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        full = full * _U(_WORD) + w[i : i + len(full)]
    full = mix(full)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            s = np.sort(full[lo : hi - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif hi > lo:
            x = np.zeros(1, np.uint64)
            for i in range(lo, hi):
                x = x * _U(_WORD) + w[i]
            s = mix(x + np.full(1, hi - lo, np.uint64) * _U(0xE7037ED1A0B428DB))
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out
