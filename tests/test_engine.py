import pandas as pd
from pyspark.sql import functions as F

from paperloom.operators import lexical, tables
from paperloom.plans.engine import NO_ANSWER, Engine
from paperloom.sources import pages, providers
from paperloom.sources.store import Store
from paperloom.streaming.ingest import ingest_stream
from paperloom.streaming.sessions import expired_sessions


def by_letters(texts):
    return [[float(t.lower().count(c)) + 0.01 for c in "abcdefgh"] for t in texts]


def test_engine_end_to_end(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.txt").write_text("Valves\nbad cabbage face\fSecond page about fed head beads")
    (src / "two.txt").write_text("Pipes\ngabbed deaf hedge")
    p = pages.read_pages(spark, str(src))
    engine = Engine(spark, str(tmp_path / "store"), embed=by_letters)
    engine.ingest(p.select("filename", "page_num", "text"), dim=8)
    assert engine.verify()["index_healthy"] and engine.store.manifest()["chunk_count"] == 3
    q = spark.createDataFrame([(1, "cabbage face"), (2, "What is the hedge")], "query_id long, query_text string")
    found = engine.search(q)
    best = {r.query_id: r.filename for r in found["hits"].filter("rank0 = 0").collect()}
    assert best == {1: "one.txt", 2: "two.txt"}
    assert engine.answer(q).count() == 2
    # a second run takes in new files only
    (src / "three.txt").write_text("aha")
    engine.ingest(pages.read_pages(spark, str(src)).select("filename", "page_num", "text"), dim=8)
    assert engine.store.manifest()["chunk_count"] == 4
    target = engine.export(str(tmp_path / "s.zip"))
    copy = Store.from_zip(spark, target, str(tmp_path / "copy"))
    assert copy.verify()["index_healthy"]
    copy.save_progress(["a"], "b", 3, 7)
    assert copy.load_progress()["completed_chunks_in_file"] == 3
    copy.clear_progress()
    assert copy.load_progress() == {}


def test_model_plugins(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embed=by_letters, complete=lambda m, t, n: "## a longer answer text\nand another wording of it", rerank=lambda pairs: [float(len(t)) for _, t in pairs])
    engine.ingest(spark.createDataFrame([("f", i, t) for i, t in enumerate(["bad cab", "deaf hedge", "face the bead head"])], "filename string, page_num int, text string"), dim=8)
    q = spark.createDataFrame([(1, "compare beads and heads")], "query_id long, query_text string")
    assert [r.text for r in engine.search(q)["hits"].filter("rank0 = 0").collect()] == ["face the bead head"]
    assert engine.answer(q).first().response == "a longer answer text\nand another wording of it"


def test_providers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert providers.retried(flaky, delay=0.001)() == 5 and len(calls) == 3
    assert providers.rate_limited(lambda: 1, 1000)() == 1


def test_failed_batch_is_null(spark):
    def embed(texts):
        if "x" in texts:
            raise OSError
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([("x",), ("y",)], "text string")
    got = {r.text: r.embedding for r in providers.embedded(df, embed, batch=1).collect()}
    assert got == {"x": None, "y": [1.0]}


def test_stream_ingest_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    page = spark.createDataFrame([("f", 1, "a b c")], "filename string, page_num long, text string")
    page.write.parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination()
    ingest_stream(spark, src, out, ck).awaitTermination()
    page.withColumn("page_num", F.lit(2).cast("long")).write.mode("append").parquet(src)
    ingest_stream(spark, src, out, ck).awaitTermination()
    ingest_stream(spark, src, out, str(tmp_path / "other")).awaitTermination()  # replayed from the start
    assert sorted(r.page_num for r in spark.read.parquet(out).collect()) == [1, 2]
    assert [(r.batch, r.page_num) for r in spark.read.parquet(out).orderBy("batch").collect()] == [(0, 1), (1, 2)]  # as the first stream wrote them


def test_sessions_expire(spark, tmp_path):
    src = str(tmp_path / "events")
    schema = "user_id long, ts timestamp"
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 10:00:00"), (1, "2024-01-01 05:00:00")]
    spark.createDataFrame(pd.DataFrame({"user_id": [r[0] for r in rows], "ts": pd.to_datetime([r[1] for r in rows])}), schema).coalesce(1).write.parquet(src)
    got = []
    stream = expired_sessions(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    spark.createDataFrame(pd.DataFrame({"user_id": [2, 3], "ts": pd.to_datetime(["2024-01-02 06:00:00"] * 2)}), schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert [(r.user_id, r.n_events) for r in got] == [(1, 2)]


def test_tables_reach_the_index(spark, tmp_path):
    """A page's tables become chunks and grids, carry titles, and poor ones are replaced by the next tier's."""
    grid = [["Part", "Size", "Mass"], ["valve", "10 mm", "2 kg"], ["pipe", "20 mm", "3 kg"], ["flange", "30 mm", "4 kg"]]
    poor = [["Only", "", ""], ["", "", "x"]]
    rows = [("a.pdf", 1, "Table 1 Fittings of the plant\nSome prose here", [grid]), ("a.pdf", 2, "More prose without a caption", [grid[:1] + grid[2:]]), ("b.pdf", 1, "plain page", []), ("b.pdf", 2, "page with a poor table", [poor])]
    p = spark.createDataFrame(rows, "filename string, page_num int, text string, tables array<array<array<string>>>")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pdf").write_text("unused")
    (src / "b.pdf").write_text("file")
    wanted = tables.poor_pages(p, pages.raw_tables(p))
    assert sorted(tuple(r) for r in wanted.collect()) == [("b.pdf", 1), ("b.pdf", 2)]
    pipes = "| Key | Value | Unit |\n|---|---|---|\n| head | 7 | bar |"
    tier = pages.found_tables(spark, str(src), wanted, lambda path, content, n: pipes if n == 2 else [], "ocr")
    assert [(r.filename, r.page_num, r.table_idx, r.extractor) for r in tier.collect()] == [("b.pdf", 2, 0, "ocr")]
    assert pages.camelot_tables("x", b"", 1) == []
    engine = Engine(spark, str(tmp_path / "store"), embed=by_letters)
    engine.ingest(p, dim=8, fallback=tier)
    got = engine.store.load()["chunk"].orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == list(range(len(got)))
    kinds = [(r.filename, r.page_num, r.chunk_type) for r in got]
    assert kinds[:6] == [("a.pdf", 1, "table-full"), *[("a.pdf", 1, "table-row")] * 4, ("a.pdf", 1, "text")]
    second = [r.text for r in got if (r.filename, r.page_num, r.chunk_type) == ("a.pdf", 2, "table-full")]
    assert second[0].startswith("Table 1 Fittings of the plant (continued)\nComplete table")
    assert any("| valve | 10 mm | 2 kg |" in r.text for r in got if r.chunk_type == "text")
    assert [r.text for r in got if r.filename == "b.pdf" and r.chunk_type == "table-row"] == ["Table columns: Key | Value | Unit\nRow 1: Key: head | Value: 7 | Unit: bar"]
    hits = engine.search(spark.createDataFrame([(1, "flange mass")], "query_id long, query_text string"))["hits"]
    assert "flange" in hits.filter("rank0 = 0").first().text


def test_the_model_gets_the_last_turns(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def model(messages, temperature, most):
        if len(messages) > 1:
            open(seen, "a").write("\n".join(f"{m['role']}: {m['content']}" for m in messages) + "\n")
            return "## "
        return ""

    engine = Engine(spark, str(tmp_path / "store"), embed=by_letters, complete=model, tries=2, delay=0.001)
    engine.ingest(spark.createDataFrame([("f", 1, "bad cab face")], "filename string, page_num int, text string"), dim=8)
    history = spark.createDataFrame([(5, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(9)] + [(6, 0, "system", "x")], "conv_id long, turn long, role string, text string")
    q = spark.createDataFrame([(1, "and the face", 5), (2, "the cab", 6)], "query_id long, query_text string, conv_id long")
    got = {r.query_id: r.response for r in engine.answer(q, history).collect()}
    assert set(got.values()) == {NO_ANSWER}
    m = {r.query_id: [(x["role"], x["content"]) for x in r.messages] for r in engine.prompts(q, history).collect()}
    assert [x for x in m[1][1:-1]] == [(("user", "assistant")[i % 2], f"turn {i}") for i in range(3, 9)]
    assert "follows up" in m[1][0][1] and "follows up" not in m[2][0][1] and len(m[2]) == 2
    assert m[1][-1][0] == "user" and m[1][-1][1].endswith("and the face") and "bad cab face" in m[1][-1][1]
    assert "turn 8" in open(seen).read()


def test_answers_are_placed_by_index(spark):
    embed = lambda texts: [{"index": i, "embedding": [float(i)]} for i in reversed(range(len(texts)))][:-1]
    got = sorted((r.text, r.embedding) for r in providers.embedded(spark.createDataFrame([(f"t{i}",) for i in range(4)], "text string").coalesce(1), embed, batch=4).collect())
    assert got == [("t0", None), ("t1", [1.0]), ("t2", [2.0]), ("t3", [3.0])]


def test_services_try_again(spark, tmp_path):
    mark = tmp_path / "tries"

    def flaky(texts):
        with open(mark, "a") as f:
            f.write("x")
        if len(mark.read_text()) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    service = providers.Service(flaky, tries=3, delay=0.001, per_second=1000.0, share=2)
    got = providers.embedded(spark.createDataFrame([("a",)], "text string").coalesce(1), service).first()
    assert got.embedding == [1.0] and mark.read_text() == "xxx"


def test_ingest_goes_on_after_a_break(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embed=by_letters)
    page = lambda f: spark.createDataFrame([(f, 1, f"face {f}")], "filename string, page_num int, text string")
    for f in ("a", "b", "c"):
        engine.ingest(page(f), dim=8)
    first = engine.store.folders()
    assert [len(first[t]) for t in ("chunk", "vector", "posting", "terms")] == [3, 3, 3, 1]
    assert {r.term: r.df for r in engine.store.load()["terms"].collect()} == {"face": 3, "a": 1, "b": 1, "c": 1}
    fresh = lexical.build(engine.store.load()["chunk"])
    key = lambda t: sorted((r.term, r.df, round(r.idf, 9)) for r in t.collect())
    assert key(fresh.terms) == key(engine.store.load()["terms"])
    engine.store.save_progress(["a"], "b", 0, 1)
    assert engine.resume() == "truncate" and engine.store.manifest()["chunk_count"] == 1
    engine.ingest(page("b"), dim=8)
    assert engine.verify()["index_healthy"] and engine.store.load_progress() == {} and engine.resume() == "nothing"
    engine.store.save_progress(["a"], "b", 0, 9)
    assert engine.resume() == "discard" and not engine.store.exists()


def test_sessions_in_a_state_store(spark, tmp_path):
    """A stream that runs twice: what expires, what is live beside it, and a session that begins again."""
    from paperloom.streaming.sessions import live_sessions, session_stream

    src, out, ck = (str(tmp_path / n) for n in ("events", "out", "ck"))
    schema = "user_id long, ts timestamp"

    def run(rows):
        spark.createDataFrame(pd.DataFrame({"user_id": [r[0] for r in rows], "ts": pd.to_datetime([r[1] for r in rows])}), schema).coalesce(1).write.mode("append").parquet(src)
        session_stream(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
        expired = spark.read.schema("user_id long, n_events long, last_seen timestamp").option("recursiveFileLookup", "true").parquet(out)
        key = lambda df: sorted((r.user_id, r.n_events, str(r.last_seen)) for r in df.collect())
        return key(expired), key(live_sessions(spark, ck))

    assert run([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 10:00:00"), (1, "2024-01-01 05:00:00")]) == ([], [(1, 2, "2024-01-01 05:00:00"), (2, 1, "2024-01-01 10:00:00")])
    # exactly 24 hours after user 1's last event: still there; a second later it isn't
    assert run([(3, "2024-01-02 05:00:00")])[0] == []
    expired, live = run([(3, "2024-01-02 05:00:01"), (2, "2024-01-02 06:00:00")])
    assert expired == [(1, 2, "2024-01-01 05:00:00")] and live == [(2, 2, "2024-01-02 06:00:00"), (3, 2, "2024-01-02 05:00:01")]
    expired, live = run([(1, "2024-01-05 00:00:00")])
    assert expired == [(1, 2, "2024-01-01 05:00:00"), (2, 2, "2024-01-02 06:00:00"), (3, 2, "2024-01-02 05:00:01")] and live == [(1, 1, "2024-01-05 00:00:00")]
