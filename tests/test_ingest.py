"""Ingests that break off, writers at once, limits over tasks, calls that are made once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from paperloom.plans.engine import Engine
from paperloom.sources import commits, providers
from paperloom.sources.batchlog import BatchLog
from paperloom.sources.store import Store

PAGE = "filename string, page_num int, text string"


def page_rows(spark, files, pages=3, words=500):
    return spark.createDataFrame([(f, p, " ".join(f"{f}{p}w{i}" for i in range(words))) for f in files for p in range(1, pages + 1)], PAGE)


def counted(folder):
    """An embedder that leaves a mark for each text that it sees."""

    def embed(texts):
        for t in texts:
            with open(os.path.join(folder, t.split()[0] + "-" + t.split()[-1]), "a") as f:
                f.write("x")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_a_killed_ingest_embeds_only_the_rest(spark, tmp_path, monkeypatch):
    (marks := tmp_path / "marks").mkdir()
    engine = Engine(spark, str(tmp_path / "store"), embed=counted(str(marks)), batch=4)
    left = [3]
    commit = BatchLog.commit

    def dies(self, entry):
        left[0] -= 1
        if left[0] < 0:
            raise KeyboardInterrupt  # after the batch's vectors were written, before its entry
        return commit(self, entry)

    monkeypatch.setattr(BatchLog, "commit", dies)
    with pytest.raises(KeyboardInterrupt):
        engine.ingest(page_rows(spark, "abc"), dim=2)  # 9 pages of 2 chunks
    monkeypatch.setattr(BatchLog, "commit", commit)
    assert not engine.store.exists()
    (folder,) = BatchLog.folders(spark, engine.store.path)
    log = BatchLog(spark, engine.store.path, folder)
    assert log.done() == {0, 1, 2} and log.pending() == [3, 4]
    at = log.progress()
    assert (at["batches"], at["completed_chunks"], at["completed_files"], at["current_file"], at["completed_chunks_in_file"]) == (3, 12, 2, "b", 6)
    assert sorted(r.filename for r in log.completed_files(engine._staged_chunks(folder)).collect()) == ["a", "b"]
    again = Engine(spark, str(tmp_path / "store"), embed=counted(str(marks)), batch=7)  # the staged size counts
    again.ingest(page_rows(spark, "abcd"), dim=2)
    times = {n: len((marks / n).read_text()) for n in os.listdir(marks)}
    assert len(times) == 24 and sum(times.values()) == 28  # only the batch that had no entry is embedded twice
    assert again.verify() == {"total_vectors": 24, "total_documents": 24, "index_healthy": True, "warning": None}
    got = again.store.load()
    assert sorted(r.chunk_id for r in got["chunk"].collect()) == list(range(24)) == sorted(r.chunk_id for r in got["vector"].collect())
    assert {r.filename for r in got["chunk"].filter("chunk_id >= 18").collect()} == {"d"}
    assert again.finish() == [] and log.progress()["batches"] == 5
    assert [(r.first_chunk, r.last_chunk, r.n_files_ended, r.current_file, r.chunks_in_current) for r in log.rows().orderBy("batch").collect()][1:] == [(4, 7, 1, "b", 2), (8, 11, 1, "b", 6), (12, 15, 0, "c", 4), (16, 17, 1, "c", 6)]


def test_a_fresh_ingest_leaves_what_broke_off(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"), embed=lambda texts: [[1.0]] * len(texts))
    engine.ingest(page_rows(spark, "a", 1), dim=1)
    engine.staged(page_rows(spark, "b", 1), dim=1)
    engine.ingest(page_rows(spark, "c", 1), dim=1, fresh=True)
    assert {r.filename for r in engine.store.load()["chunk"].collect()} == {"c"}
    assert engine.finish() == [] and [r.chunk_count for r in engine.store.history().orderBy("number").collect()] == [2, 0, 2]
    assert {r.filename for r in engine.store.load(1)["chunk"].collect()} == {"a"}
    engine.store.reset()
    assert engine.store.load() == {} and engine.verify()["total_vectors"] == 0


def test_two_savers_at_once_keep_both(spark, tmp_path, monkeypatch):
    """All writers see the same version before any of them commits; later ones begin anew, and none is lost."""
    path, n = str(tmp_path / "store"), 4
    Store(spark, path).save({"chunk": spark.createDataFrame([(0, "first"), (1, "first")], "chunk_id long, text string")}, 0)
    gate, first = threading.Barrier(n), threading.local()
    manifest = Store.manifest

    def together(self, number=None):
        out = manifest(self, number)
        if number is None and not getattr(first, "over", False):
            first.over = True
            gate.wait(60)
        return out

    monkeypatch.setattr(Store, "manifest", together)

    def words(old):
        n = old["terms"].first().df if "terms" in old else 0
        return {"terms": spark.createDataFrame([("w", n + 1)], "term string, df long")}

    def save(k):
        rows = spark.createDataFrame([(i, f"writer {k}") for i in range(3)], "chunk_id long, text string")
        Store(spark, path).save({"chunk": rows, "vector": rows.select("chunk_id")}, 0, append=("chunk", "vector"), rebase=words)

    threads = [threading.Thread(target=save, args=(k,)) for k in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    monkeypatch.setattr(Store, "manifest", manifest)
    store = Store(spark, path)
    got = store.load()
    rows = sorted((r.chunk_id, r.text) for r in got["chunk"].collect())
    assert [i for i, _ in rows] == list(range(2 + 3 * n)) and len({t for _, t in rows}) == n + 1
    assert all(len({t for _, t in rows[2 + 3 * k : 5 + 3 * k]}) == 1 for k in range(n))  # a writer's rows stand together
    assert sorted(r.chunk_id for r in got["vector"].collect()) == list(range(2, 2 + 3 * n))
    assert got["terms"].first().df == n and store.versions() == list(range(1, n + 2))
    assert store.manifest()["chunk_count"] == 2 + 3 * n


def test_commits(spark, tmp_path):
    path = f"{tmp_path}/deep/er/one.json"
    assert commits.names(spark, f"{tmp_path}/deep/er") == []
    wins = []
    threads = [threading.Thread(target=lambda k=k: wins.append(commits.create_if_absent(spark, path, f"text {k} é"))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(wins) == [False] * 7 + [True] and commits.names(spark, f"{tmp_path}/deep/er") == ["one.json"]
    assert commits.read_text(spark, path).startswith("text ") and os.listdir(tmp_path / "deep" / "er") == ["one.json"]
    with pytest.raises(ValueError, match="no such tables"):
        Store(spark, str(tmp_path / "s")).save({"other": spark.range(1)}, 0)
    store = Store(spark, str(tmp_path / "s"))
    store.save({"chunk": spark.createDataFrame([(0,)], "chunk_id long")}, 3)
    with pytest.raises(ValueError, match="components"):
        store.save({"chunk": spark.createDataFrame([(0,)], "chunk_id long")}, 4, append=("chunk",))
    assert store.commit(next(iter(store.folders()["chunk"])), {}, 3)["number"] == 1  # repeated: nothing new


def test_the_limit_holds_over_four_tasks(spark, tmp_path):
    rate, calls = 20.0, 60

    def call(texts):
        import time

        with open(tmp_path / f"{os.getpid()}", "a") as f:
            f.write(f"{time.time()}\n")
        return [[1.0]] * len(texts)

    service = providers.Service(call, per_second=rate, share=4)
    rows = spark.range(calls).select(F.array(F.col("id").cast("string")).alias("texts")).repartition(9)
    assert providers.embedded_batches(rows, service).filter("vectors[0][0] = 1").count() == calls
    at = sorted(float(x) for p in os.listdir(tmp_path) for x in (tmp_path / p).read_text().split())
    assert len(os.listdir(tmp_path)) > 1 and len(at) == calls  # several workers called
    assert all(at[i + 20] - at[i] > 0.9 for i in range(calls - 20))  # about a second for any 20 calls after one
    assert at[-1] - at[0] < 3 * calls / rate


def test_slots():
    lanes = [[providers.next_slot(5.0, 10.0, 4, lane, 5.0 + t) for t in (0.0, 0.31, 2.0)] for lane in range(4)]
    assert lanes == [[0, 4, 20], [1, 5, 21], [2, 6, 22], [3, 7, 23]]  # 0.31 s: the slot at 0.3 s is over, lane 3's next is 7
    providers._TAKEN[7.0, 1] = 9
    assert providers.next_slot(7.0, 10.0, 4, 1, 7.0) == 13
    assert (providers.lanes_for(100, 3.0), providers.lanes_for(4, 50.0), providers.lanes_for(6, None), providers.lanes_for(8, 0.1)) == (6, 4, 6, 1)


def test_batches_are_rows(spark):
    def embed(texts):
        if "bad" in texts:
            raise OSError
        return [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(texts))) if t != "skip"]

    rows = spark.createDataFrame([(1, ["a", None, "same", "skip", "same"]), (2, ["same", "bad"]), (3, [])], "k int, texts array<string>")
    got = {r.k: r.vectors for r in providers.embedded_batches(rows, embed).collect()}
    assert got == {1: [[1.0], None, [4.0], None, [4.0]], 2: [None, None], 3: []}


def test_each_prompt_is_one_call(spark, tmp_path):
    said = tmp_path / "said"
    texts = tmp_path / "texts"

    def model(messages, temperature, most):
        with open(said, "a") as f:
            f.write(f"{most} {temperature}\n")
        return os.urandom(12).hex() + " is what the model says\nand a second line of it"  # never the same

    def embed(some):
        with open(texts, "a") as f:
            f.write("x" * len(some) + "\n")
        return [[float(len(t)), 1.0] for t in some]

    engine = Engine(spark, str(tmp_path / "store"), embed=embed, complete=model, keep_answers=True)
    engine.ingest(page_rows(spark, "ab"), dim=2)
    os.unlink(texts)
    q = spark.createDataFrame([(1, "compare a1w3 and b2w7 for their use")], "query_id long, query_text string")
    first = engine.answer(q).first()
    calls = sorted(said.read_text().split("\n")[:-1])
    assert calls == ["200 0.1", "200 0.3", "250 0.1", "2500 0.2"]  # one each: passage, wordings, rewriting, answer
    assert texts.read_text() == "xxxxx\n"  # the five texts of a question in one call
    assert engine.answer(q).first() == first and len(said.read_text().split("\n")) == 5  # kept, so not asked again
    simple = spark.createDataFrame([(1, "what is a1w3"), (2, "what is a1w3")], "query_id long, query_text string")
    got = engine.answer(simple).collect()
    assert len(got) == 2 and got[0].response == got[1].response and len(said.read_text().split("\n")) == 7  # rewriting and answer


def test_failed_calls_are_made_again(spark, tmp_path):
    mark = tmp_path / "tries"

    def model(messages, temperature, most):
        with open(mark, "a") as f:
            f.write("x")
        if len(mark.read_text()) == 1:
            raise OSError
        return messages[0]["content"].upper()

    answers = providers.Answers(spark, model, str(tmp_path / "answers"))
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, t string").withColumns({"messages": F.when(F.col("t").isNotNull(), providers.message("user", F.col("t"))), "temperature": F.lit(0.0), "most": F.lit(5)})
    got = lambda: sorted((r.id, r.said) for r in answers.answered(rows, "said").collect())
    assert got() == [(1, None), (2, None), (3, None)] and got() == [(1, "A"), (2, "A"), (3, None)] == got()
    assert mark.read_text() == "xx"


def test_a_held_provider_is_made_once_a_worker(spark, tmp_path):
    def make():
        with open(tmp_path / f"{os.getpid()}", "a") as f:
            f.write("made\n")
        return lambda pairs: [float(len(t)) for _, t in pairs]

    held = providers.Held(make, "lengths")
    hits = spark.range(400).repartition(16).select((F.col("id") % 40).alias("query_id"), F.col("id").alias("rank0"), F.lit("q").alias("query_text"), F.col("id").cast("string").alias("text"))
    for _ in range(2):
        assert providers.reranked(hits, held, 2).count() == 80
    made = [(tmp_path / p).read_text() for p in os.listdir(tmp_path)]
    assert made and set(made) == {"made\n"}


def test_small_batches_share_jobs(spark, tmp_path, monkeypatch):
    """Their entries and vectors are those of batches that are embedded one by one; jobs are far fewer than batches."""
    pages = spark.createDataFrame([(f"f{i % 7}", i, "w " * (1 + i % 5)) for i in range(60)], "filename string, page_num long, text string")
    lots, whole = [], Engine.embed_batches
    monkeypatch.setattr(Engine, "embed_batches", lambda self, log, batches, vectors=None: lots.append(batches) or whole(self, log, batches, vectors))
    embed = lambda texts: [None if len(t) % 5 == 0 else [float(len(t)), 1.0] for t in texts]
    engine = Engine(spark, str(tmp_path / "store"), embed=embed, batch=3)
    log = engine.staged(pages)
    engine.finish()
    assert sum(lots, []) == list(range(20)) and len(lots) <= 9
    got = [tuple(r) for r in log.rows().drop("written").orderBy("batch").collect()]
    again = engine.staged(pages)
    assert got == [tuple(engine.embed_batch(again, k).values()) for k in range(20)]
    assert sum(r[4] for r in got) == engine.store.load()["vector"].count() > 0


def test_a_batch_reads_no_other_batch(spark, tmp_path, monkeypatch):
    """The table of where batches end is made once; after it a lot reads its own staged chunks only, so that an ingest grows with
    its input. Files over several batches, a null file and files of several pages are told apart as before."""
    texts = [(f"f{i % 5}", i, "w " * (1 + i % 900)) for i in range(0, 900, 30)] + [("long", 1, "v " * 3000), (None, 1, "u " * 500)]
    pages = spark.createDataFrame(texts, "filename string, page_num long, text string")
    engine = Engine(spark, str(tmp_path / "store"), embed=lambda texts: [None if len(t) % 5 == 0 else [1.0] for t in texts], batch=4)
    log = engine.staged(pages)
    rows = [r.asDict() for r in engine._staged_chunks(log.folder).orderBy("chunk_id").collect()]
    key = lambda r: (r["filename"] is not None, r["filename"], r["page_num"], r["chunk_seq"])
    assert [r["chunk_id"] for r in rows] == list(range(len(rows))) and rows == sorted(rows, key=key)
    read, whole = [], Engine._staged_chunks
    monkeypatch.setattr(Engine, "_staged_chunks", lambda self, folder, batches=None: read.append(batches) or whole(self, folder, batches))
    pending = log.pending()
    got = engine.embed_batches(log, pending[:2])
    for lot in (pending[2:5], pending[5:]):
        before = len(read)
        got += engine.embed_batches(log, lot)
        assert read[before:] == [lot]
    assert read.count(None) == 1
    for e in got:
        here = rows[e["first_chunk"] : e["last_chunk"] + 1]
        last = here[-1]["filename"]
        ended = {r["filename"] for r in here} - {r["filename"] for r in rows[e["last_chunk"] + 1 :]}
        current = [r["chunk_id"] for r in rows[: e["last_chunk"] + 1] if r["filename"] == last]
        n = sum(len(r["text"]) % 5 != 0 for r in here)
        assert (e["n_files_ended"], e["current_file"], e["chunks_in_current"], e["n_vectors"], e["n_skipped"]) == (len(ended), last, len(current), n, len(here) - n)


def test_a_piece_is_one_task(spark, tmp_path, monkeypatch):
    """Batches larger than a piece are staged and embedded by several tasks; a call's texts are of one file and one piece."""
    from paperloom.plans import engine as engines

    monkeypatch.setattr(engines, "PIECE", 3)
    calls = tmp_path / "calls"

    def embed(texts):
        with open(calls, "a") as f:
            f.write(" ".join(t.split()[0] for t in texts) + "\n")
        return [[float(len(t)), 1.0] for t in texts]

    pages = spark.createDataFrame([(f"f{f}", p, f"f{f}p{p:02d} x") for f in range(2) for p in range(10)], "filename string, page_num long, text string")
    engine = Engine(spark, str(tmp_path / "store"), embed=embed, batch=8)
    assert engine.ingest(pages, dim=2)["chunk_count"] == 20 == engine.verify()["total_vectors"]
    at = lambda lo, hi: " ".join(f"f{k // 10}p{k % 10:02d}" for k in range(lo, hi))
    assert sorted(calls.read_text().splitlines()) == sorted(at(*c) for c in [(0, 3), (3, 6), (6, 8), (8, 10), (10, 11), (11, 14), (14, 16), (16, 19), (19, 20)])
