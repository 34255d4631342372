"""Whitening and clustering against numpy on whole lists of vectors."""

import hashlib

import numpy as np
import pytest

from paperloom.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component string, cluster string, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "c", "k", "h") for i, v in rows], SCHEMA)


def floats(a):
    return [float(x) for x in np.asarray(a, np.float32)]


def whole(v, plus=0):
    return [int(np.floor(64 * float(np.float32(c)))) + plus for c in v]


def odd_rows(dim):
    return [(901, None), (902, [None, *[0.1] * (dim - 1)]), (903, [float("nan")] * dim), (904, [float("inf"), *[0.0] * (dim - 1)]), (905, [])]


def by_hand(rows, k):
    """The fit list's components in numpy, from whole numbers."""
    x = np.array(sorted({tuple(whole(v, 1_000_000)) for _, v in rows}), np.int64)
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, w = np.linalg.eigh(v)
    return x, e[::-1][:k], w[:, ::-1][:, :k].T, np.trace(v)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) / 8
    rows = [(i, floats(v)) for i, v in enumerate(base)]
    rows += [(i + 1000, rows[7][1]) for i in range(200)]  # one vector holds two fifths of the rows
    rows += [(7, rows[8][1]), (None, rows[9][1])]
    got = whitening.whitened(table(spark, rows + odd_rows(20)).repartition(7)).collect()
    x, e, w, trace = by_hand(rows, 16)
    n, sums = len(x), x.sum(axis=0)
    assert {r["n"] for r in got} == {n} and len(got) == 16 * len(rows)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    out = {}
    for r in got:
        out.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r
    for i, v in rows:
        own = np.array(whole(v, 1_000_000), object)
        found = out[(i, int(((n * own - sums.astype(object)) ** 2).sum()))]
        assert sorted(found) == list(range(1, 17))
        want = ((own - sums.astype(object) / n).astype(float) @ w.T) / np.sqrt(e)
        for c in range(16):
            r = found[c + 1]
            assert abs(r["whitened"]) == pytest.approx(abs(want[c]), abs=1e-7) and r["explained"] == pytest.approx(e[c] / trace, rel=1e-9)
            assert r["deviation_digits"] is None
    signs = {c: set() for c in range(16)}  # a component's sign is the same for all rows
    for i, v in rows[10:60]:
        own = np.array(whole(v, 1_000_000), object)
        found = out[(i, int(((n * own - sums.astype(object)) ** 2).sum()))]
        for c in range(16):
            signs[c].add(np.sign(found[c + 1]["whitened"]) * np.sign((own - sums / n).astype(float) @ w[c]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_other_lengths_and_no_variance(spark):
    rng = np.random.default_rng(4)
    long_, short = [(i, floats(v)) for i, v in enumerate(rng.normal(size=(60, 6)))], [(i + 100, floats(v)) for i, v in enumerate(rng.normal(size=(40, 3)))]
    flat = [(200 + i, [0.5, float(i), 0.5, 0.5]) for i in range(9)]  # one dimension varies
    one = [(300, [0.1] * 5), (301, [0.1] * 5)]
    got = {}
    for r in whitening.whitened(table(spark, long_ + short + flat + one)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert {len(got[i]) for i, _ in long_} == {6} and {len(got[i]) for i, _ in short} == {3}
    assert got[0][0]["n"] == 60 and got[100][0]["n"] == 40
    assert [(r["whitened"] is None, r["explained"]) for r in sorted(got[203], key=lambda r: r["component"])] == [(False, 1.0), (True, 0.0), (True, 0.0), (True, 0.0)]
    assert got[203][0]["identity_error"] < 1e-12
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got[300]) and len(got[301]) == 5
    assert whitening.whitened(table(spark, odd_rows(4))).count() == 0
    assert whitening.whitened(table(spark, [])).count() == 0


def test_whitening_of_huge_numbers(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [5e4, 2.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(table(spark, rows)).collect()}
    x = [[min(max(v, -(1 << 52)), 1 << 52) for v in whole(v)] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for (i, _), v in zip(rows, x):
        want, r = sum((3 * a - b) ** 2 for a, b in zip(v, s)), got[i, 1]
        assert (r["deviation"], r["deviation_digits"]) == ((want, None) if i == 3 else (None, str(want)))


def test_chan_merging_is_the_whole():
    rng = np.random.default_rng(5)
    y = rng.integers(-500, 500, (257, 9))
    parts = [whitening.moments(p) for p in np.split(y, [1, 5, 90, 200])]
    m = whitening.merged(whitening.merged(parts[0], parts[1]), whitening.merged(parts[2], whitening.merged(parts[3], parts[4])))
    one = whitening.moments(y)
    assert (m.n, m.sums) == (257, one.sums)
    assert np.allclose(m.mean, one.mean) and np.allclose(m.scatter, one.scatter, rtol=1e-12)


@pytest.mark.parametrize("block", [1, 8, 64])
def test_partial_distances_give_the_nearest(block):
    rng = np.random.default_rng(6)
    x, c = rng.integers(-9, 9, (500, 64)), rng.integers(-9, 9, (16, 64))
    c[5], c[11] = c[2], x[3]  # ties go to the smaller number
    x[9] = c[2]
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    number, distance, done = centroids.nearest(x, c, rng.permutation(64), block)
    assert number.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()
    assert number[9] == 2 and distance[9] == 0


def test_partial_distances_save_work():
    rng = np.random.default_rng(7)
    c = rng.integers(-64, 64, (16, 64)) * (np.arange(64) < 12)
    x = c[rng.integers(0, 16, 2000)] + rng.integers(-6, 6, (2000, 64))
    assert centroids.nearest(x, c, np.arange(64))[2] < 0.35 * 2000 * 16 * 64


def clusters_by_hand(rows, k, rounds):
    v = [(i, whole(e)) for i, e in rows]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else hashlib.sha256(b"1").hexdigest(), x) for i, x in v)[:k]
    c = [x for _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        lots = {}
        for _, x in v:
            lots.setdefault(near(x)[1], []).append(x)
        c = [[sum(d) // len(lots[j]) for d in zip(*lots[j])] if j in lots else y for j, y in enumerate(c)]
    got = [(i, *near(x)) for i, x in v]
    sums = {}
    for _, d, j in got:
        sums[j] = sums.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, j, d, sums[j], sum(sums.values()), digest[j]) for i, d, j in got), key=repr)


@pytest.mark.parametrize("n", [0, 5, 150])
def test_clusters_against_brute_force(spark, n):
    rng = np.random.default_rng(8)
    rows = [(i, floats(v)) for i, v in enumerate(rng.normal(size=(n, 64)))]
    if n > 5:
        rows += [(i + 1000, rows[3][1]) for i in range(80)] + [(3, rows[4][1]), (None, rows[5][1]), (2000, [0.0] * 64)]
    got = centroids.clustered(table(spark, rows + odd_rows(64) + [(906, [0.5] * 63), (907, [0.5] * 65)]).repartition(6))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == clusters_by_hand(rows, 16, 3)


def test_clusters_of_huge_numbers(spark):
    got = centroids.clustered(table(spark, [(i, [1e30 * (-1) ** i] * 64) for i in range(40)]), k=1, rounds=1).collect()
    assert {(r["distance"], r["inertia"]) for r in got} == {(64 * (1 << 54), None)}
