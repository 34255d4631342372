"""Repeated windows within one block of texts, by a blockwise suffix sort with a difference cover.

A block holds whole suffix buckets: every text window that could equal one of the block's is in it. The suffixes that
start a window are sorted by their first PERIOD bytes. Long ties are resolved by ranks of a sample of suffixes, worked
out before: the sample's places form a difference cover modulo PERIOD, so for any two suffixes there is a distance
below PERIOD at which both meet sample places, and the ranks there tell the order. Ties are split by a three-way
quicksort of all groups at once. Memory: a few words a byte of the block.
"""

from __future__ import annotations

import numpy as np

PERIOD = 31
#: A perfect difference set modulo 31: every distance is a difference of two members.
COVER = (1, 5, 11, 24, 25, 27)
_IN_COVER = np.full(PERIOD, -1, np.int64)
_IN_COVER[list(COVER)] = np.arange(len(COVER))
#: By two residues, the least distance at which both are in the cover.
_DISTANCE = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)], np.int64)
#: Zero bytes after the block's text, so that no read needs a check.
PAD = 512


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number that sorts as they do."""
    n = len(text) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= text[k : k + n]
    return out


def _by_head(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by their first PERIOD bytes, and which of them, in order, differ from the one before."""
    keys = [w[at + k] for k in (0, 8, 16, PERIOD - 8)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


def _sample_ranks(w: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the sample's suffixes by at least depth bytes, by prefix doubling in steps of whole periods."""
    at = (np.arange(-(-n // PERIOD) + 1)[:, None] * PERIOD + np.array(COVER)).ravel()
    order, new = _by_head(w, np.minimum(at, len(w) - PERIOD - 1))
    rank, step, known = _dense(order, new), len(COVER), PERIOD
    while known < depth and not new.all():
        ahead = np.concatenate([rank[step:] + 1, np.zeros(step, np.int64)])
        key = rank * (len(rank) + 1) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank, step, known = _dense(order, new), 2 * step, 2 * known
    return rank


def suffix_order(text: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """text: the block's bytes with PAD zeros after; at: where windows of size bytes start. The windows in an order
    in which equal ones are neighbours, and which of them, in order, differ from the one before."""
    w = _words(text)
    order, new = _by_head(w, at)
    if not len(at) or new.all():
        return order, new
    rank = _sample_ranks(w, len(text) - PAD, size)

    def ranked(place: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        place = place + ahead
        return rank[place // PERIOD * len(COVER) + _IN_COVER[place % PERIOD]]

    ids = np.cumsum(new) - 1
    tied = np.bincount(ids)[ids] > 1
    slots = np.flatnonzero(tied)
    group = ids[slots]
    settled = np.zeros(len(at), bool)  # equals the one before for certain
    while len(slots):
        first = np.concatenate([[True], group[1:] != group[:-1]])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(slots)))
        mine = at[order[slots]]
        pivot = np.repeat(mine[starts + counts // 2], counts)
        ahead = _DISTANCE[mine % PERIOD, pivot % PERIOD]
        a, b = ranked(mine, ahead), ranked(pivot, ahead)
        side = (a > b).astype(np.int64) - (a < b) + 1
        key = np.repeat(np.arange(len(starts)), counts) * 3 + side
        if not (key[1:] >= key[:-1]).all():
            by = np.argsort(key, kind="stable")
            order[slots] = order[slots][by]
            key = key[by]
        same = np.concatenate([[False], key[1:] == key[:-1]])
        middle = key % 3 == 1
        settled[slots[same & middle]] = True
        size_of = np.bincount(key)[key]
        left = ~middle & (size_of > 1)
        slots, group = slots[left], key[left]
    # equal to the one before: settled, or the same in all bytes
    pair = np.flatnonzero(~new & ~settled)
    p, q = at[order[pair]], at[order[pair - 1]]
    alive = np.arange(len(pair))
    for k in (*range(PERIOD - PERIOD % 8, size - 8, 8), size - 8):
        alive = alive[w[p[alive] + k] == w[q[alive] + k]]
    new = np.ones(len(at), bool)
    new[settled] = False
    new[pair[alive]] = False
    return order, new


def repeated(texts: list[bytes], weights: list[int], size: int = 200) -> list[np.ndarray]:
    """For each text, which of its windows of size bytes occur at two places or more of all texts, where a text
    counts as often as its weight says."""
    joined = np.frombuffer(b"".join(texts) + bytes(PAD), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(n) - n
    many = np.maximum(n - size + 1, 0)
    first = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(texts)), many)
    at = np.arange(int(many.sum())) - first[owner] + base[owner]
    order, new = suffix_order(joined, at, size)
    run = np.cumsum(new) - 1
    total = np.bincount(run, np.array(weights, np.float64)[owner[order]]) if len(at) else np.zeros(0)
    out = np.zeros(len(at), bool)
    out[order] = total[run] > 1
    return np.split(out, first[1:])
