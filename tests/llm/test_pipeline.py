"""The pipeline on planted cases, and each stage's columns."""

import random
import threading

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["ka", "no", "mi", "ru", "ta", "se", "lo"]) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows, labels = [], []
    for i in range(160):
        good = i % 5 > 0
        t = text(rng.randrange(60, 160))
        rows.append((i, t if good else (word() + " ") * 120))
        labels.append((i, int(good), 0))
    passage = text(80)
    rows += [(200, rows[1][1]), (201, rows[2][1].replace(" ", " zz ", 1)), (202, text(90) + " " + passage + " " + text(90)), (203, text(90) + " " + passage + " " + text(90)), (204, None), (205, "123 456"), (206, "")]
    path = str(tmp_path_factory.mktemp("pipe"))
    spark.createDataFrame([(i, t, "aa", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(rows), passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == COLUMNS, name
        docs = corpus_pipeline.written(docs, "test")
        seen.append({r.doc_id: r for r in docs.collect()})
    language, good, unique, cut = seen
    assert set(texts) - set(language) == {204, 205, 206}
    assert set(language) - set(good) == {i for i in range(160) if i % 5 == 0}
    assert set(good) - set(unique) == {200, 201}
    assert set(cut) == set(unique) and all(r.n_chars == len(r.text) for r in cut.values())
    assert passage not in cut[202].text and passage not in cut[203].text and cut[7].text == texts[7]


def test_run(spark, folder):
    path, _, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(got) >= 128 and max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)


def test_runs_leave_each_other_alone(spark, folder):
    """A result can be read after further runs, also when two went on at once."""
    path, _, _ = folder
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    first = corpus_pipeline.run(spark, path)
    found = {}
    threads = [threading.Thread(target=lambda k=k: found.update({k: corpus_pipeline.run(spark, path)})) for k in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    stage = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    rows = key(found[1])
    assert rows and rows == key(found[0]) == key(first) == key(found[1])
    assert stage.count() == stage.count() > 100


def test_empty(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_odd_rows_at_every_stage(spark, folder):
    """Null and repeated ids, null, empty and very long texts, repeated rows and columns called as stages' own ones: no
    stage but near-dedup drops a text for them, and that one drops no other."""
    path, texts, _ = folder
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice(["ka", "no", "mi", "ru"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    good = [(i, t) for i, t in texts.items() if i < 160 and i % 5]
    long, a, b, c = text(60_000), text(90), text(90), text(90)
    odd = [(None, a), (None, b), (None, None), (7000, c), (7000, text(90)), (7001, ""), (7002, long), (7003, text(100)), (7003, None)]
    twice = [(7004, text(120))] * 2
    rows = good + odd + twice
    docs = spark.createDataFrame([(i, t, "aa", "s", None, "x", "x", "x", "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, lang_pred string, score string, statistics string").repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rs: sorted(((r.doc_id, r.text) for r in rs), key=repr)
    ran = {n: stages[n](spark, docs, path).collect() for n in list(stages)[:-1]}
    assert key(ran["language ID"]) == sorted([r for r in rows if r[1]], key=repr)
    kept = key(ran["quality classifier"])
    assert [r for r in kept if r[1]] == sorted([r for r in rows if r[1]], key=repr)
    assert key(ran["MinHash near-dedup"]) == sorted(set(rows), key=repr)
    cut = key(ran["suffix-array dedup"])
    assert len(cut) == len(rows) and cut.count((7004, "")) == 2 and (None, a) in cut and (7002, long) in cut and (7003, None) in cut
    got = stages["best-fit packing"](spark, docs, path).collect()
    ends = [r for r in got if r.piece == 0]
    assert len(ends) == len(rows) and sum(r.doc_id is None for r in ends) == 3 and sum(r.doc_id == 7002 for r in got) > 10


def test_near_duplicates_by_row(spark):
    """Rows with a null doc_id or one that others have too are documents of their own."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    near = lambda t: t + " zz"
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, near(c)), (3, c), (4, d), (4, near(c)), (4, e), (4, e), (5, f), (1, near(f)), (7, None), (8, None), (None, None), (9, near(b)), (-5, near(a))]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(-5, near(a)), (9, near(b)), (3, c), (4, d), (4, e), (1, near(f)), (7, None), (8, None), (None, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_many_documents_without_id(spark):
    docs = spark.range(300).selectExpr("cast(if(id % 3 = 0, null, id) as long) doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> md5(concat(id, '-', i)))) text", "'aa' lang", "'s' source", "1L n_chars")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.text for r in got) == sorted(r.text for r in docs.collect()) and sum(r.doc_id is None for r in got) == 100


@pytest.mark.parametrize("langs", [1, 2, 3])
def test_text_in_no_learned_language(spark, langs):
    """However few languages there are, and though a net names one of them for every text."""
    rng = random.Random(3)
    syllables = [["ka", "no", "mi", "ru", "ta", "se", "lo"], ["strö", "gß", "ünd", "ich", "pf"], ["ció", "ña", "ez", "ado", "ll"]][:langs]
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."
    rows = [(i, text(i % langs, rng.choice([4, 30, 200])), "abc"[i % langs]) for i in range(300)]
    rows += [(300, rows[0][1].upper(), "a"), (301, "No. 4711: " + rows[1][1] + " 0123456789 $$$", "b"), (302, text(0, 20), None), (303, text(langs - 1, 3000), "a"), (304, "ka", "a")]
    other = ["Съешь же ещё этих мягких французских булок, да выпей чаю.", "すべての人間は、生まれながらにして自由である", "Wszyscy bywaj\u0105 wolni pod wzgl\u0119dem swej godno\u015bci.", "Qwx hgjv zzyxq bwvd fjqg hvbx."]
    planted = [(400 + i, t, lang) for i, t in enumerate(other) for lang in ("a",)] + [(410, other[0] * 50, None)]
    docs = spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows + planted], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert {r[0] for r in rows} - got == set() and got & {r[0] for r in planted} == set()
