"""Language ID and quality: held-out accuracy on made-up texts, and defined results for edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import langid, quality
from paperloom.llm.common import utf8

SYLLABLES = {"aa": ["ka", "no", "mi", "ru", "ta"], "bb": ["strö", "gß", "ünd", "ich", "pf"], "cc": ["ció", "ña", "ez", "ado", "ll"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([5, 40, 400])), lang) for i in range(400)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "aa"), (None, sentence(rng, "bb", 50), "bb"), (1003, sentence(rng, "bb", 50), None), (1004, sentence(rng, "cc", 20_000), "cc")]
    df = spark.createDataFrame([(i, t, g, "x", "y") for i, t, g in rows + odd], "doc_id long, text string, lang string, score string, held_out string")
    got = langid.identified(df, per_lang=200).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out]
    lang = {i: g for i, _, g in rows + odd}
    assert {r.doc_id for r in held} == {i for i in lang if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    real = [r for r in held if r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in real]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[None].lang_pred == "bb" and not by_id[None].held_out
    assert by_id[1004].lang_pred == "cc"
    assert langid.identified(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identified(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang <> ''")).collect()} == set()


def test_network_by_hand():
    """The network's output against sums written out place by place, and its gradients against small differences."""
    rng = np.random.default_rng(5)
    net = langid.started(["p", "q", "r"], rng)
    for name in ("embed", "filters", "bias", "weights", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias += rng.normal(0, 0.2, net.bias.shape)
    w, y, weigh = rng.integers(0, 256, (4, langid.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1]), np.array([0.5, 1.0, 2.0])
    want = np.zeros((4, 3))
    for i in range(4):
        pooled = []
        for f in range(len(net.bias)):
            width = langid.WIDTHS[f // langid.FILTERS]
            kernel = net.filters[:, f].reshape(-1, langid.EMBED)
            places = langid.WINDOW - max(langid.WIDTHS) + 1
            best = max(sum(float(net.embed[w[i, at + k]] @ kernel[k]) for k in range(width)) for at in range(places))
            pooled.append(max(0.0, best + net.bias[f]))
        z = np.array(pooled) @ net.weights + net.offset
        want[i] = z - np.log(np.exp(z).sum())
    assert np.allclose(net.log_probs(w), want)
    loss, grads = langid.gradients(net, w, y, weigh)
    assert np.isclose(loss, (-want[np.arange(4), y] * weigh[y]).mean())
    for name, g in zip(("embed", "filters", "bias", "weights", "offset"), grads):
        x = getattr(net, name)
        flat = np.flatnonzero(np.abs(g) > 1e-4)
        for at in rng.choice(flat, min(12, len(flat)), replace=False):
            kept, h = x.flat[at], 1e-6
            x.flat[at] = kept + h
            up = langid.gradients(net, w, y, weigh)[0]
            x.flat[at] = kept - h
            down = langid.gradients(net, w, y, weigh)[0]
            x.flat[at] = kept
            assert np.isclose((up - down) / (2 * h), g.flat[at], rtol=1e-3, atol=1e-6)


def test_sample_is_bounded_and_never_empty(spark):
    rng = random.Random(9)
    same = [(7, "ein und derselbe Text", "bb")] * 3000
    many = [(i, sentence(rng, "aa", 30), "aa") for i in range(900)]
    few = [(5000, sentence(rng, "cc", 500), "cc")]
    df = spark.createDataFrame(same + many + few, "doc_id long, text string, lang string")
    got = langid.sampled(df, per_lang=50)
    texts = {lang: int((got.labels == k).sum()) for k, lang in enumerate(got.langs)}
    assert got.langs == ["aa", "bb", "cc"] and texts["bb"] == 1 and 50 <= texts["aa"] <= 50 * langid.WINDOWS and 1 <= texts["cc"] <= langid.WINDOWS
    again = langid.sampled(df.repartition(13), per_lang=50)
    assert (again.windows == got.windows).all() and (again.labels == got.labels).all()
    assert langid.sampled(df.limit(0)) is None and langid.sampled(df.selectExpr("doc_id", "cast(null as string) text", "lang")) is None
    out = langid.annotated(df.withColumn("score", df.lang), langid.fit(got))
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r.lang_pred for r in out.filter("lang = 'aa'").collect()} == {"aa"}


def test_windows_join_up():
    net = langid.train(np.random.default_rng(0).integers(0, 255, (64, langid.WINDOW), dtype=np.uint8), np.arange(64) % 2, ["p", "q"], epochs=1)
    texts = ["a" * n for n in (0, 1, 255, 256, 257, 200_000)] + ["é" * 300]
    at, score = langid.predict(net, *utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        mean = net.log_probs(langid.cut(np.frombuffer(t.encode(), np.uint8))).mean(axis=0)
        assert at[i] == mean.argmax() and abs(score[i] - np.exp(mean).max() / np.exp(mean).sum()) < 1e-5


def test_statistics_by_hand():
    texts = ["Ab c!", "", "x x x y", "É|1", "w " * 400_000]
    got = quality.statistics(*utf8(pa.array(texts)))
    name = {n: i for i, n in enumerate(quality.NAMES)}
    first = got[0]
    assert np.isclose(first[name["letters"]], 3 / 5) and np.isclose(first[name["upper"]], 1 / 3) and np.isclose(first[name["bangs"]], 1 / 5)
    assert (got[1] == 0).all()
    assert np.isclose(got[2][name["again"]], 2 / 4) and np.isclose(got[2][name["top"]], 3 / 4) and np.isclose(got[2][name["pairs"]], 1 - 2 / 3)
    assert np.isclose(got[3][name["wide"]], 1.0) and np.isclose(got[3][name["symbols"]], 1 / 3)
    assert np.isclose(got[4][name["letters"]], 0.5) and np.isclose(got[4][name["top"]], 1)


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0.1, 0.0, 0.4, 0.3, 0.9, 0.8]), np.array([1.0, 3, 1, 1, 1, 1]))
    assert (np.diff(y) > 0).all() and np.isclose(y[0], 0.025) and np.isclose(y[-1], 0.85) and (np.diff(x) > 0).all()


def test_isotonic_by_brute_force():
    """The mean of least squares among all non-decreasing step functions: max over starts of min over ends of means."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(1, 12))
        y, w = rng.normal(size=n), rng.integers(1, 5, n).astype(float)
        x, steps = quality.isotonic(np.arange(float(n)), y, w)
        mean = lambda a, b: float((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum())
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.unique(np.round(want, 9)), np.round(steps, 9)) and (np.diff(x) > 0).all()
        assert np.allclose(np.interp(np.arange(float(n)), *quality.knots(np.arange(float(n)), y, w)), want)


def test_fit_by_hand(spark):
    """Weights against one ridge system over all rows, steps against scores across folds, features against the kernel."""
    rng = np.random.default_rng(8)
    n = 300
    x = rng.normal(size=(n, len(quality.NAMES)))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    measured = spark.createDataFrame([(i, i % 5 == 0, *map(float, r)) for i, r in enumerate(x)], "doc_id long, held_out boolean, " + ", ".join(f"{c} double" for c in quality.NAMES))
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(measured.repartition(7), labels)
    rows = np.array([i for i in range(n) if i % 5])
    z = (x - x[rows].mean(0)) / x[rows].std(0)
    f = model.features(x)
    assert np.allclose(model.mean, x[rows].mean(0)) and np.allclose(model.scale, x[rows].std(0))
    hold = np.diag([*[quality.RIDGE * len(rows)] * quality.FEATURES, 1e-9 * len(rows)])
    want = np.linalg.solve(f[rows].T @ f[rows] + hold, f[rows].T @ y[rows])
    assert np.allclose(model.weights, want, atol=1e-6)
    kernel = np.exp(-((z[:40, None] - z[None, :40]) ** 2).sum(-1) / (2 * quality.KERNEL_WIDTH**2))
    assert np.abs(f[:40, :-1] @ f[:40, :-1].T - kernel).mean() < 0.08
    fold = np.array([r[0] for r in spark.range(n).selectExpr(f"pmod(xxhash64(id), {quality.FOLDS}) h").collect()])
    raw = np.zeros(n)
    for k in range(quality.FOLDS):
        other = rows[fold[rows] != k]
        hold = np.diag([*[quality.RIDGE * len(other)] * quality.FEATURES, 1e-9 * len(other)])
        raw[fold == k] = f[fold == k] @ np.linalg.solve(f[other].T @ f[other] + hold, f[other].T @ y[other])
    bins = ((np.clip(raw, quality.LOW, quality.HIGH) - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS).astype(int).clip(0, quality.BINS - 1)
    at = np.unique(bins[rows])
    steps = quality.knots(quality.LOW + (at + 0.5) * (quality.HIGH - quality.LOW) / quality.BINS, np.array([y[rows][bins[rows] == b].mean() for b in at]), np.array([(bins[rows] == b).sum() for b in at], float))
    assert np.allclose(model.steps[0], steps[0], atol=1e-6) and np.allclose(model.steps[1], steps[1], atol=1e-6)


def test_quality_keeps_other_columns(spark):
    docs = spark.createDataFrame([(i, "a word or two " * (i % 9), "old", "x", i) for i in range(60)] + [(None, None, "old", "x", 1), (60, "w " * 300_000, "old", "x", 1)], "doc_id long, text string, Score string, `a.statistics` string, held_out int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.annotated(docs, labels)
    assert got.columns == ["doc_id", "text", "a.statistics", "held_out", "score", "predicted"]
    want = {(r.doc_id, r.score, r.predicted) for r in quality.scored(docs, labels).collect()}
    assert {(r.doc_id, r.score, r.predicted) for r in got.collect()} == want and {r["a.statistics"] for r in got.collect()} == {"x"}


def test_quality(spark):
    rng = random.Random(2)
    good = lambda: sentence(rng, "aa", rng.randrange(20, 200))
    bad = lambda: rng.choice([sentence(rng, "aa", 1) * 90, sentence(rng, "aa", 60).upper().replace(" ", "!! "), sentence(rng, "aa", 60).replace(" ", "### ")])
    rows = [(i, good() if i % 4 else bad()) for i in range(500)]
    odd = [(900, None), (901, ""), (None, good()), (3, good())]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows + odd], "doc_id long, text string, score string, y string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 500)] + [(None, 1), (900, None), (901, 7)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.scored(docs, labels.filter("quality = 1")).collect()} == {1.0}


def test_every_language_is_learned(spark):
    """More languages than a fixed list would hold: each has letters of its own, the last ones have the fewest texts."""
    rng = random.Random(4)
    letters = lambda k: [chr(0x4E00 + 40 * k + i) for i in range(12)]
    text = lambda k: " ".join("".join(rng.choice(letters(k)) for _ in range(3)) for _ in range(25))
    rows, doc_id = [], 0
    for k in range(230):
        for _ in range(16 if k < 200 else 12):
            rows.append((doc_id, text(k), f"l{k:03}"))
            doc_id += 1
    got = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    right = {}
    for r in got:
        if r.held_out and int(rows[r.doc_id][2][1:]) >= 200:
            right[r.doc_id] = r.lang_pred == rows[r.doc_id][2]
    assert len(right) > 40 and np.mean(list(right.values())) > 0.8


def test_language_learns_from_all_rows(spark, monkeypatch):
    """Counts, network and threshold are of all rows, not of the sample that the network starts from."""
    rows = [(i, f"ab{'cdefgh'[i % 6]} und der weg " * 20, "x") if i % 2 else (i, f"qu{'rstvwz'[i % 6]} with the way " * 20, "y") for i in range(200)]
    odd = [(1000 + i, "zzz kkk vvv " * 10, "x") for i in range(8)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(5)
    counted = langid._labelled(docs).select("lang", "text").mapInArrow(langid._count_trigrams, "lang string, code int, n long").groupBy("lang").sum("n").collect()
    got = {r[0]: r[1] for r in counted}
    want = dict.fromkeys("xy", 0)
    for _, text, lang in rows + odd:
        w = langid.cut(np.frombuffer(text.encode(), np.uint8))
        want[lang] += sum(int(langid._trigrams(x)[1].sum()) for x in np.pad(w, ((0, 0), (0, 1))))
    assert got == want
    net, known = langid.fitted_with_familiar(docs, per_lang=4)
    start = langid.fit(langid.sampled(docs.filter(~langid.held_out()), 4))
    assert np.isfinite(known.least) and not np.array_equal(net.weights, start.weights)
    code, _ = langid._trigrams(np.frombuffer(b"zzz", np.uint8))
    assert known.log_p[code[0]] > np.log(0.01 / (1 << langid.TRIGRAM_BITS)) + 1  # seen, whether or not a sample of four has it
    right = [r for r in langid.annotated(docs, net, known).collect() if r.lang == r.lang_pred]
    assert len(right) >= len(rows)  # the odd ones are too few to be likely
