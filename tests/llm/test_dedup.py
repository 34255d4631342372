"""Near-duplicates, embeddings, suffixes and components, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import neardup, shingles, substrings, suffixes, vecdup
from paperloom.llm.common import utf8
from paperloom.llm.components import components, forest


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = word_list(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def near_texts(seed, groups, copies):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 12, 80, 300]))]
        for _ in range(rng.randrange(1, copies)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append((" " if g % 2 else "\n").join(t).title())
    return out


@pytest.mark.parametrize("span", [64, 1 << 20])
def test_shingles(span, monkeypatch):
    monkeypatch.setattr(shingles, "SPAN", span)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", "Thé"]) + rng.choice([" ", "", "\n", "\t ", " "]) for _ in range(rng.choice([0, 1, 4, 5, 40, 200]))) for _ in range(400)] + [None]
    seen = {}
    for t, s in zip(texts, shingles.shingle_sets(*utf8(pa.array(texts)))):
        assert len(s) == len(shingle_set(t))
        assert seen.setdefault(shingle_set(t), s.tobytes()) == s.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_super_minhash_by_steps():
    """The batched signature is the one that goes element by element through whole permutations."""

    def slow(elements, places):
        out = np.full(places, np.inf)
        for h in elements:
            p = list(range(places))
            for j in range(places):
                draw = shingles.mix(np.array([h]) + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                k = j + int((shingles.mix(draw ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(places - j))[0])
                p[j], p[k] = p[k], p[j]
                out[p[j]] = min(out[p[j]], float(draw[0] >> np.uint64(11)) * 2.0**-53 + j)
        return out

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (0, 1, 3, 40, 300)]
    got = neardup.super_minhash(sets, 32)
    assert all((got[i] == slow(s, 32)).all() for i, s in enumerate(sets))


def test_super_minhash_estimates():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 350, dtype=np.uint64)
        s = neardup.super_minhash([np.sort(x[:300]), np.sort(x[50:])])
        errors.append((s[0] == s[1]).mean() - 250 / 350)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.04


def check_near(documents, texts):
    got = {r.doc_id: r for r in neardup.grouped(documents(texts)).collect()}
    sets = {i: shingle_set(t) for i, t in texts}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = grouped(ids, links)
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i)


def test_near_duplicates(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = [*near_texts(1, 60, 8), "", None, "Same", "same", "x " * 500, "x " * 501]
    check_near(documents, list(enumerate(texts)))


def test_near_duplicates_with_shared_passage(documents, monkeypatch):
    """Texts that share most, but mostly too little: buckets hold many components."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"q{rng.randrange(12)}" for _ in range(rng.randrange(8, 30))]) for _ in range(70)]
    check_near(documents, list(enumerate(texts)))


def test_near_edge_rows(documents, spark):
    got = neardup.grouped(documents([(5, "a b"), (5, "a b"), (None, "a b"), (None, None), (9, "a b")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in got) == [(False, 5, 5), (False, 5, 5), (False, 9, 5), (True, 0, 0), (True, 0, 5)]
    assert neardup.grouped(documents([(1, "x")]).limit(0)).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 50_000, n).astype(np.uint64)) for n in (0, 1, 30, 20_000, 25_000)]
    got = neardup.shared_counts(sets, sets[1:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets]).all()


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)]
    df = spark.createDataFrame(links, "a long, b long").repartition(6)
    got = {r.node: r.root for r in components(df).collect()}
    want = grouped({x for p in links for x in p}, links)
    assert {n: got.get(n, n) for n in want} == want
    assert components(df.limit(0)).count() == 0
    assert dict(forest([(3, 1), (2, 3), (7, 8), (5, 5)])) == {3: 1, 2: 1, 8: 7}


def brute_windows(texts, weights, size):
    count = collections.Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - size + 1):
            count[t[i : i + size]] += w
    return [[count[t[i : i + size]] > 1 for i in range(len(t) - size + 1)] for t in texts]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh", bytes(range(256))])
def test_suffix_sort(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(25):
        pool = bytes(rng.choice(alphabet) for _ in range(rng.choice([250, 900])))
        texts = []
        for _ in range(rng.randrange(1, 20)):
            n = rng.randrange(0, 450)
            i = rng.randrange(0, max(1, len(pool) - n))
            t = bytearray(pool[i : i + n])
            for _ in range(rng.choice([0, 0, 1, 3])):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(alphabet)
            texts.append(bytes(t))
        weights = [rng.choice([1, 1, 2]) for _ in texts]
        size = rng.choice([40, 200])
        assert [x.tolist() for x in suffixes.repeated(texts, weights, size)] == brute_windows(texts, weights, size)


def test_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def brute_removed(texts):
    raw = [(t or "").encode() for t in texts]
    out = []
    for t, hit in zip(raw, brute_windows(raw, [1] * len(raw), 200)):
        gone = bytearray(len(t))
        for i, h in enumerate(hit):
            if h:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
    shared = [" ".join(word() for _ in range(rng.choice([20, 45, 60, 200]))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 6))]
        texts.append(rng.choice([" ", "\n"]).join(parts))
    return [*texts, texts[3], texts[5], texts[5], "", None, "ab" * 700, "a" * 450, "xy" + "a" * 199, "b" * 199, "b" * 200, "b" * 201, "tail " * 90 + "end"]


@pytest.mark.parametrize("large", [2000, 2, 1, 0])
def test_suffix_dedup(documents, large, monkeypatch):
    monkeypatch.setattr(substrings, "LARGE", large)
    texts = passages(large)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.deduplicated(documents(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_suffix_edge_rows(documents):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(300))
    rows = [(1, long), (1, long), (None, "é" * 150), (None, "é" * 150), (4, None)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.deduplicated(documents(rows)).collect())
    assert got == [(0, 300, 300, 1), (0, 300, 300, 1), (1, 300, 300, 1), (1, 300, 300, 1), (4, 0, 0, 0)]
    kept = substrings.stripped(documents([(1, long), (2, "é" + long + "é"), (3, None)]).select("doc_id", "text", "lang", "source", "n_chars"))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "", 2: "éé", 3: None}
    assert substrings.deduplicated(documents(rows).limit(0)).count() == 0


def test_chunks_of_a_long_text(documents, monkeypatch):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [part + "".join(rng.choice("abcdefgh ") for _ in range(300_000)) + part[100:4000], "q" + part[:250]]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.deduplicated(documents(list(enumerate(texts)))).collect()}
    want = brute_removed(texts)
    assert got == {i: w[1:3] for i, w in enumerate(want)}


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 24))
    near = base[rng.integers(0, 30, 120)] + rng.normal(size=(120, 24)) * rng.choice([0.02, 0.2, 0.45], (120, 1))
    x = np.vstack([base, near, base[:10] * 3])
    return [(int(i * 3), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(spark, block):
    rows = vectors(7)
    odd = [(2, None), (5, [0.0] * 24), (8, [1.0, None] + [0.0] * 22), (11, [float("nan")] * 24), (14, [1.0]), (17, [1e308] * 24), (20, [1e-310] * 24)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + odd], "vec_id long, embedding array<double>, unit string, rep string")
    got = {r.vec_id: r for r in vecdup.grouped(df, block=block).collect()}
    x = np.array([v for _, v in rows + odd[5:]])
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in rows + odd[5:]]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= d for i, d in zip(ids, link.sum(1))) and found >= 0.9 * link.sum()
    root = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link))])
    assert np.mean([got[i].component_id == root[i] for i in ids]) > 0.95
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (2, 5, 8, 11, 14))
    assert got[17].component_id == 17 and got[20].component_id == 17


def test_vector_edge_rows(spark):
    schema = "vec_id long, embedding array<float>"
    got = vecdup.grouped(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [2.0, 0.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component_id or 0, r.n_links, r.kept) for r in got) == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True), (3, 1, 3, False)]
    got = vecdup.grouped(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (4, [0.0, 1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.component_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, 0, True), (0, 0, 1, True), (0, 0, 1, True), (4, 4, 0, True)]
    assert vecdup.grouped(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_several_lengths(spark, kind):
    """Vectors link within their length, whichever is the most common; rows without an id link too."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 3 else i, (rng.normal(size=d) + np.arange(d) * (i % 2)).astype("f4").tolist()) for i, d in enumerate(rng.choice([2, 3, 8, 40], 400, p=[0.2, 0.5, 0.2, 0.1]))]
    rows += [(1000, [1.0, 0.0]), (1001, [1.0, 0.01]), (1002, [5.0]), (1003, [7.0]), (1004, [-1.0]), (1005, [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k long, vec_id long, embedding array<{kind}>")
    x = [np.array(v, np.float64) for _, v in rows]
    link = np.array([[i != j and len(a) == len(b) and len(a) > 0 and float(a @ b) >= 0.9 * float(np.linalg.norm(a) * np.linalg.norm(b)) for j, b in enumerate(x)] for i, a in enumerate(x)])
    root = grouped(list(range(len(rows))), list(zip(*np.nonzero(link))))
    least = collections.defaultdict(list)
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[root[i]].append(vec_id)
    want = [(vec_id, int(link[i].sum()), min(least[root[i]], default=None)) for i, (vec_id, _) in enumerate(rows)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in vecdup.grouped(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def linked_pairs(n, dim=64, cosine=0.9):
    """n pairs of unit vectors of this cosine, or a little more, without other structure."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(11)
    a, other = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    other = unit(other - (other * a).sum(1, keepdims=True) * a)
    cosine += 1e-9
    return a, cosine * a + np.sqrt(1 - cosine**2) * other


def test_recall_near_the_threshold(spark):
    a, b = linked_pairs(5000)
    rows = [(i, v.tolist()) for i, v in enumerate(np.stack([a, b], 1).reshape(-1, 64))]
    got = vecdup.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.n_links for r in got} <= {0, 1} and sum(r.n_links for r in got) / len(got) > 0.995


@pytest.mark.parametrize("n_pivots", [2_000, vecdup.MAX_PIVOTS])
def test_recall_with_the_pivots_of_large_tables(n_pivots):
    """The pivots of a million and of 67 million vectors; pairs of cosine 0.9 that are none of them."""
    a, b = linked_pairs(2000)
    pivots = np.random.default_rng(12).normal(size=(n_pivots, 64))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    unit = pa.array([v.tobytes() for v in np.stack([a, b], 1).reshape(-1, 64)], pa.binary())
    ids = pa.array(range(4000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array([1] * 4000, pa.int64()), unit], ["rep", "weight", "raw"])
    described = pa.Table.from_batches(vecdup._describe({64: (0, pivots)}, "<f8")([batch]))
    lists = np.array(described.column("pivots").to_pylist())
    found = collections.Counter()
    for p in np.unique(lists):
        rows = described.filter(pa.array((lists == p).any(axis=1)))
        for name, value in (("mine", 0), ("x", 0), ("y", 0), ("pivot", int(p))):
            rows = rows.append_column(name, pa.array([value] * rows.num_rows, pa.int32()))
        out = vecdup._links(0.9, "<f8")(rows)
        found.update(dict(zip(out.column("rep").to_pylist(), out.column("n").to_pylist())))
    assert set(found.values()) == {1} and len(found) / 4000 > 0.995


@pytest.mark.parametrize("hot", [0, 90])
def test_counts_of_shared_pivots(hot):
    """Against sets; with hot, so many share a pivot that its pairs are counted apart."""
    rng = np.random.default_rng(hot)
    lists = [np.array([rng.permutation(60)[:7] for _ in range(n)], np.int32) for n in (110, 130)]
    for near in lists:
        near[:hot, 3] = 60
    got = vecdup.shared_pivots(*lists, 20)
    for i, a in enumerate(lists[0].tolist()):
        for j, b in enumerate(lists[1].tolist()):
            both = set(a) & set(b)
            assert got[i, j] == len(both) if not both or min(both) >= 20 else got[i, j] < 0


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near, far = list(words), words[:75_000] + [f"v{i}" for i in range(75_000)]
    for i in range(0, len(near), 40):
        near[i] = "changed"
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(far))]
    got = {r.doc_id: r for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: shingle_set(t) for i, t in rows}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(x) for i, x in want.items()}
    assert 100 * len(want[3] & want[5]) >= 75 * len(want[3] | want[5]) and 100 * len(want[4] & want[5]) < 75 * len(want[4] | want[5])
    assert {i: r.component_id for i, r in got.items()} == {3: 3, 4: 4, 5: 3}


def test_stripped_keeps_any_columns(spark):
    rng = random.Random(22)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = text(300)
    texts = ["x" + shared + "y" * 5, text(250) + shared, text(400), None, "é" * 150, "q" + "é" * 150]
    schema = "id string, same int, runs string, COPIED int, doc_id long, text string, row string, bucket string, `a.b` string"
    df = spark.createDataFrame([("i", 1, "r", 2, None if i == 1 else i, t, "w", "b", "ab") for i, t in enumerate(texts)], schema)
    got = substrings.stripped(df)
    assert got.schema == df.schema
    left = {r.doc_id: r.text for r in got.collect()}
    assert left[0] == "x" + "y" * 5 and left[None] == texts[1][: -len(shared)] and left[2] == texts[2] and left[3] is None
    assert left[4] == "" and left[5] == "q"


def test_hot_window_bucket_is_sorted(spark, monkeypatch):
    """Very many different strings around one passage: buckets split down to windows, none of which has over 256."""
    monkeypatch.setattr(substrings, "LARGE", 20)
    seen = []
    kept = substrings._found
    monkeypatch.setattr(substrings, "_found", lambda rows, docs, splits=substrings.SPLITS: seen.append((len(splits), max(r[1] for r in rows.groupBy("bucket").count().collect()))) or kept(rows, docs, splits))
    rng = random.Random(23)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(196))
    texts = [(i, "".join(rng.choice("abc") for _ in range(3)) + passage + "".join(rng.choice("abc") for _ in range(5))) for i in range(400)]
    got = {r.doc_id: r.n_removed for r in substrings.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    count = collections.Counter(w for _, t in texts for w in {(t[i : i + 200], i) for i in range(len(t) - 199)})
    total = collections.Counter()
    for (w, _), n in count.items():
        total[w] += n
    for i, t in texts:
        hit = [k for k in range(len(t) - 199) if total[t[k : k + 200]] > 1]
        assert got[i] == len({x for k in hit for x in range(k, k + 200)})
    most = dict(seen)
    assert set(most) == {0, 1, 2} and most[2] > 20 and most[1] > 20 and most[0] <= 256


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_without_id_link(spark, documents, seed):
    """A null doc_id links like any other row, also as the only bridge between two; it names no component."""
    rng = random.Random(seed)
    vocab = [f"n{i}" for i in range(4000)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(90)]
        chain = [list(base)]
        for step in range(4):  # each is similar to the one before, and the ends are not
            t = list(chain[-1])
            for i in rng.sample(range(90), 2):
                t[i] = rng.choice(vocab)
            chain.append(t)
        for t in chain:
            for _ in range(rng.choice([1, 1, 2])):
                k += 1
                rows.append((None if rng.random() < 0.5 else k, " ".join(t)))
    rows += [(None, rows[0][1]), (None, None), (None, ""), (k + 1, None), (None, "one two"), (None, "one two"), (k + 2, "three four")]
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = grouped(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root[i]] = min(doc, least.get(root[i], doc))
    want = sorted(((doc, len(sets[i]), c := least.get(root[i]), doc == c) for i, (doc, _) in enumerate(rows)), key=repr)
    bridged = {least[root[i]] for i in range(len(rows)) if root[i] in least} < {doc for doc, _ in rows if doc is not None}
    got = sorted(map(tuple, neardup.grouped(documents(rows).repartition(5)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    assert bridged and got == want
