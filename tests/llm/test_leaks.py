"""The positional index against brute force over lists of words."""

import hashlib
import random
import re

import numpy as np
import pytest

from paperloom.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, size=10, near=2):
    asked = set()
    for i, t in items:
        w = word_list(t)
        asked |= {(None if i is None else str(i), tuple(w[k : k + size])) for k in range(max(len(w) - size, 0) + 1) if w}
    count = {}
    for _, t in docs:
        for w in word_list(t):
            count[w] = count.get(w, 0) + 1
    out = []
    for i, t in docs:
        w = word_list(t)
        hit, found, beside = set(), set(), set()
        for item, u in asked:
            for at in range(len(w) - len(u) + 1):
                if tuple(w[at : at + len(u)]) == u:
                    hit |= set(range(at, at + len(u)))
                    found.add(item)
            if all(x in count for x in u):
                _, first = min((count[x], k) for k, x in enumerate(u))
                for at in (k - first for k, x in enumerate(w) if x == u[first]):
                    if all(x in w[max(at + k - near, 0) : max(at + k + near + 1, 0)] for k, x in enumerate(u)):
                        beside.add(item)
        ids = sorted(found - {None})
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), len(beside - {None})))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    vocab = ["the", "of", "Ünï", "語", "a1", "B", *[f"w{i}" for i in range(40)]]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", ", ", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 40]))) for k in range(12)] + [(50, None), (51, " .! "), (None, text(12)), (3, text(14)), (60, text(25))]
    items.append((61, items[-1][1]))  # two items with the same windows
    docs = []
    for i in range(40):
        w = word_list(text(rng.choice([0, 2, 30, 90])))
        for _ in range(rng.choice([0, 1, 2])):
            u = word_list(rng.choice(items)[1])
            lo = rng.randrange(len(u) + 1)
            u = u[lo : lo + rng.choice([3, 10, 13, 40])]
            if len(u) > 2 and rng.random() < 0.4:
                u.insert(rng.randrange(len(u)), "between")
            at = rng.randrange(len(w) + 1)
            w[at:at] = u
        docs.append((i, rng.choice([" ", ". ", "\t"]).join(w).title()))
    return docs + [(100, None), (101, ""), (102, "..."), (None, items[-1][1]), (5, items[-1][1]), (5, items[-1][1])], items


def tables(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs], "doc_id long, text string, row string, terms string, items string")
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")


@pytest.mark.parametrize("part", [1 << 19, 100])
def test_contaminated_against_brute_force(spark, part, monkeypatch):
    docs, items = case(part)
    monkeypatch.setattr(decontaminate, "STARTS", 30)
    got = decontaminate.contaminated(*tables(spark, docs, items))
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items)


def test_passes_and_whole_vocabulary(spark):
    """The same rows by several passes, and with an index of all words."""
    docs, items = case(7)
    d, b = tables(spark, docs, items)
    asked = decontaminate.windows(b)
    some, whole = decontaminate.index(d, asked.selectExpr("explode(terms)")), decontaminate.index(d)
    rows = [sorted((r["row"], i) for r in decontaminate.search(ix, asked, at_once=n).collect() for i in r["items"]) for ix, n in ((some, 1 << 17), (whole, 40))]
    assert rows[0] and sorted(set(rows[1])) == rows[0]


def test_parts_of_long_texts_overlap():
    """A part's end cuts no window: matches of the parts are those of the whole."""
    rng = np.random.default_rng(1)
    text, start, size = decontaminate._parts(np.array([0, 3, decontaminate.PART, 3 * decontaminate.PART + 5]))
    assert (np.bincount(text).tolist(), start[:3].tolist(), size[:3].tolist()) == ([1, 1, 1, 4], [0, 0, 0], [0, 3, decontaminate.PART])
    ends = start + size
    assert (start[4:] == ends[3:-1] - decontaminate.GAP).all() and ends[-1] == 3 * decontaminate.PART + 5
    lo, hi = decontaminate._runs(np.array([5, 3, 20, 14]), np.array([10, 1, 2, 3]))
    assert (lo.tolist(), hi.tolist()) == ([3, 5, 20], [4, 17, 22]) and rng is not None


def test_a_very_long_document(spark, monkeypatch):
    """One text of several parts (on the workers parts are of full size)."""
    rng = random.Random(4)
    words = [f"v{rng.randrange(5000)}" for _ in range(decontaminate.PART + 3000)]
    cut = decontaminate.PART
    items = [(1, " ".join(words[cut - 5 : cut + 5])), (2, " ".join(words[cut - 70 : cut - 40])), (3, " ".join(words[-12:])), (4, " ".join(words[:11])), (5, " ".join(f"q{i}" for i in range(10)))]
    got = decontaminate.contaminated(*tables(spark, [(9, " ".join(words)), (10, "x")], items)).orderBy("doc_id").collect()
    assert tuple(got[0])[:4] == (9, len(words), 10 + 30 + 12 + 11, 4) and tuple(got[1])[:4] == (10, 1, 0, 0)


def test_empty_tables(spark):
    docs, items = case(2)
    assert decontaminate.contaminated(*tables(spark, [], items)).count() == 0
    got = decontaminate.contaminated(*tables(spark, docs, [])).collect()
    assert len(got) == len(docs) and not any(r["contaminated"] or r["n_near"] for r in got)
    with pytest.raises(ValueError, match="words at most"):
        decontaminate.matched(*tables(spark, docs, items), window=63)
