import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import chat, chunking, dense, fusion, ingest, lexical, postprocess, tables
from paperloom.operators.numbering import with_row_numbers
from paperloom.sources.providers import reranked


def test_chunk_counts(spark):
    counts = [0, 1, 400, 401, 720, 721]
    df = spark.createDataFrame([("f", n, " ".join(f"w{i}" for i in range(n))) for n in counts], "filename string, page_num int, text string")
    got = {r[0]: r[1] for r in chunking.text_chunks(df).groupBy("page_num").count().collect()}
    assert [got.get(n, 0) for n in counts] == [0, 1, 1, 2, 2, 3]


def test_chunks_cover_and_overlap(spark):
    df = spark.createDataFrame([("f", 1, " ".join(f"w{i}" for i in range(1000)))], "filename string, page_num int, text string")
    got = [r.text.split() for r in chunking.text_chunks(df).orderBy("chunk_seq").collect()]
    assert got[0][-80:] == got[1][:80] and got[-1][-1] == "w999" and [len(g) for g in got] == [400, 400, 360]


def test_numbers(spark):
    df = spark.createDataFrame([(f"f{i % 3}", i) for i in range(100)], "a string, b int")
    got = with_row_numbers(df, ["a", "b"], "n").collect()
    want = {(a, b): i for i, (a, b) in enumerate(sorted((f"f{i % 3}", i) for i in range(100)))}
    assert {(r.a, r.b): r.n for r in got} == want
    assert with_row_numbers(df.limit(0), ["a", "b"], "n").count() == 0


def test_bm25_by_hand(spark):
    docs = {0: "a b b", 1: "a c", 2: "a", 3: ""}
    df = spark.createDataFrame(list(docs.items()), "chunk_id long, text string")
    q = spark.createDataFrame([(7, "b A a zz")], "query_id long, query_text string")
    n, avg = 4, 6 / 4
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in {"a": 3, "b": 1, "c": 1}.items()}
    mean = sum(idf.values()) / 3
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}

    def score(i):
        w = docs[i].split()
        return sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("b", "a", "a") if t in w)

    got = {r.chunk_id: r.score for r in lexical.scores(lexical.build(df), q).collect()}
    assert set(got) == {0, 1, 2} and all(abs(got[i] - score(i)) < 1e-12 for i in got)


def test_dense_floor_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.25, math.sqrt(1 - 0.0625)])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [3.0, 0.0]), (9, None)], "query_id long, embedding array<double>")
    got = [(r.rank0, r.chunk_id) for r in dense.dense_topk(v, q, 10).orderBy("rank0").collect()]
    assert got == [(0, 1), (1, 2), (2, 5)]
    assert dense.add_vectors(v.limit(0), v, 2).count() == 4


@pytest.mark.parametrize("block, vector_block", [(2048, 16384), (7, 16384), (7, 10), (1, 1000)])
def test_dense_blocks(spark, block, vector_block):
    """Queries that don't fit a block meet the vectors in a shuffle, with the same best ones."""
    x = np.random.default_rng(3).normal(size=(90, 8))
    x[40:45] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    v = spark.createDataFrame([*rows, (90, None), (91, [1.0])], "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([*rows[:25], (99, None)], "query_id long, embedding array<double>")
    best = dense.ranked(dense.dense_scores(v, q, 6, block, vector_block), 6)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = np.round(u @ u.T, 9)
    wanted = [(i, k, int(c)) for i in range(25) for k, c in enumerate(np.lexsort((np.arange(90), -s[i]))[:6])]
    assert sorted((r.query_id, r.rank0, r.chunk_id) for r in best.collect()) == wanted



def test_hybrid(spark):
    schema = "query_id long, rank0 int, chunk_id long, score double"
    d = spark.createDataFrame([(0, i, i + 1, 0.9) for i in range(3)], schema)
    x = spark.createDataFrame([(0, 0, 3, 5.0), (0, 1, 4, 4.0)], schema)
    got = {r.chunk_id: round(r.rrf_score, 6) for r in fusion.hybrid(d, x, 10).collect()}
    assert got == {3: 0.032266, 1: 0.016393, 2: 0.016129, 4: 0.016129}


def test_weighted(spark):
    rows = [(0, 0, 3.0, 0, "s", "k1", 1), (0, 0, 3.0, 1, "s", "k2", 2), (0, 1, 0.5, 0, "s", "k2", 3)]
    lists = spark.createDataFrame(rows, "query_id long, list_seq int, weight double, rank0 int, source string, text string, chunk_id long")
    got = [(r.text, r.chunk_id, round(r.rrf_score, 6)) for r in fusion.weighted(lists).orderBy("rank0").collect()]
    assert got == [("k2", 3, 0.056584), ("k1", 1, 0.04918)]


def test_dedup(spark):
    rows = [(0, 0, "s", "a b c d e"), (0, 1, "s", "a b c d e f"), (0, 2, "t", "a b c d e"), (0, 3, "s", "x y")]
    hits = spark.createDataFrame(rows, "query_id long, rank0 int, source string, text string")
    once = postprocess.dedup_text(hits)
    assert sorted(r.rank0 for r in once.collect()) == [0, 2, 3]
    assert postprocess.dedup_text(once).count() == 3
    v = hits.select("query_id", "rank0", F.when(F.col("rank0") == 1, F.lit(None)).otherwise(F.array(F.lit(1.0), F.col("rank0") * 0.01)).alias("embedding"))
    assert sorted(r.rank0 for r in postprocess.dedup_semantic(v).collect()) == [0, 1]


def test_conflicts(spark):
    text = "Wall Thickness is 3 mm and Wall Thickness is 4.5 mm; Max 10 barrels"
    schema = "query_id long, rank0 int, source string, text string"
    assert postprocess.conflicts(spark.createDataFrame([(0, 0, "a", text)], schema)).count() == 0
    both = spark.createDataFrame([(0, 0, "a", "Wall is 3 mm"), (0, 1, "b", "Wall is 4 MM"), (1, 0, "a", "no value"), (2, 0, "c", "at 5 bar"), (2, 1, "d", "at 5 bar")], schema)
    got = postprocess.conflicts(both).collect()
    assert [(r.query_id, r.message) for r in got] == [(0, "CONFLICT in Wall mm: 3.0 mm (a), 4.0 mm (b)")]


def test_windows(spark):
    chunks = spark.createDataFrame([(i, "s", "text", t) for i, t in enumerate("abc")] + [(9, "t", "text", "z"), (10, "s", "table-full", "q")], "chunk_id long, source string, chunk_type string, text string")
    hits = spark.createDataFrame([(0, 0, "s", "text", "b"), (0, 1, "s", "text", "a"), (0, 2, "t", "text", "z"), (0, 3, "s", "table-row", "b")], "query_id long, rank0 int, source string, chunk_type string, text string")
    got = {r.rank0: r.window_text for r in postprocess.sentence_windows(hits, chunks).collect()}
    assert got == {0: "a b c", 1: "a b", 2: "z", 3: "b"}
    ctx = postprocess.contexts(postprocess.sentence_windows(hits, chunks), spark.createDataFrame([], "query_id long, conflict_key string, n_values int, first_rank int, message string")).first()
    assert ctx.context.startswith("RELEVANT DOCUMENTS:") and not ctx.has_conflicts


def cells_frame(spark, cells):
    return spark.createDataFrame([(cells,)], "cells array<array<string>>")


@pytest.mark.parametrize(("cells", "want"), [([["A", "B", "C"], ["1", "", ""], ["2", "3", ""]], 0.65), ([["A", ""], ["1", "2"]], 0.1), ([["A"]], 0.0), ([["A", "B"], ["1", "2"]], 0.9)])
def test_quality(spark, cells, want):
    assert cells_frame(spark, cells).select(tables.quality("cells")).first()[0] == want


def test_collapse(spark):
    wide = [["Key", "", None, "Size", ""], ["1", "x", None, "", "9"], ["2", "y", None, "", "8\n7"], ["3", None, None, "", " "]]
    got = cells_frame(spark, wide).select(tables.collapsed("cells")).first()[0]
    assert got == [["Key", "Key"], ["1", "x"], ["2", "y"], ["3", ""]]
    assert cells_frame(spark, [["a", None]]).select(tables.collapsed("cells")).first()[0] == [["a", ""]]


def test_markdown(spark):
    text = "x\n| a | b |\n|---|:-: |\n| 1 | 2 |\n\n| z |\ny\n| p | q |\n| r | s |"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(tables.markdown_tables("t")).collect()
    assert got[0][0] == [[["a", "b"], ["1", "2"]], [["p", "q"], ["r", "s"]]] and got[1][0] == []


def test_table_chunks(spark):
    cells = [["A", "B"], *[[str(i), f"v{i}"] for i in range(1, 5)]]
    df = spark.createDataFrame([("f", 2, 0, cells, "")], "filename string, page_num int, table_idx int, cells array<array<string>>, page_text string")
    got = {(r.row_kind, r.seq): r.text for r in tables.table_chunks(df).collect()}
    assert [k for k in got if k[0] == "triple"] == [("triple", 7)]
    assert got["triple", 7] == "Table columns: A | B\nRows 1-3: A: 2 | B: v2 ; A: 3 | B: v3 ; A: 4 | B: v4"
    assert got["full", 0].splitlines()[:3] == ["Complete table (page 2, table 1):", "+---+----+", "| A | B  |"]
    assert sum(k[0] == "row" for k in got) == 4


def test_titles_carry(spark):
    rows = [("f", 1, 0, "Table 1 A"), ("f", 2, 0, "none"), ("g", 1, 0, "none")]
    df = spark.createDataFrame(rows, "filename string, page_num int, table_idx int, page_text string")
    got = {(r.filename, r.page_num): r.title for r in tables.carried_titles(df).collect()}
    assert got == {("f", 1): "Table 1 A", ("f", 2): "Table 1 A (continued)", ("g", 1): ""}


def test_chat(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "x" * (400 + i % 2)) for i in range(21)] + [(1, 21, "system", "no")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.stored(m).count() == 20 and chat.last_messages(m).count() == 6
    lines = chat.summaries(m).first().summary.split("\n")
    assert lines[1] == "User: " + "x" * 400 and lines[2] == "Assistant: " + "x" * 400 + "..."
    f = spark.createDataFrame([(1, 0, "user", "What about valves"), (1, 1, "assistant", "a"), (1, 2, "user", "What about valves"), (2, 0, "assistant", "a"), (2, 1, "user", "unit size")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.turn): r.is_followup for r in chat.followups(f).collect()} == {(1, 0): False, (1, 2): True, (2, 1): True}


def test_ingest_rules(spark):
    assert [ingest.resume_decision(n, 100) for n in (116, 90, 100)] == [("truncate", 100), ("discard", 0), ("resume", 100)]
    e = spark.sql("select 1 user_id, timestamp_ntz'2024-01-02 00:00:00' ts union all select 2, timestamp_ntz'2024-01-01 00:00:00' union all select 3, timestamp_ntz'2023-12-31 23:59:59'")
    assert [r.user_id for r in ingest.idle_sessions(e).collect()] == [3]
    s = spark.createDataFrame([("f", i, "error: x" if i % 2 else None) for i in range(30)], "filename string, page_num int, reason string")
    assert [tuple(r) for r in ingest.skip_report(s).collect()] == [("error", 15, "1, 3, 5, 7, 9, 11, 13, 15, 17, 19 +5 more")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=20, unique=True))
def test_rrf_bounds(spark, pairs):
    lists = spark.createDataFrame([(0, s, 1.0, r, "s", f"t{r}") for r, s in pairs], "query_id long, list_seq int, weight double, rank0 int, source string, text string")
    got = fusion.weighted(lists).collect()
    assert all(0 < r.rrf_score <= 4 / 61 + 1e-12 for r in got) and len(got) == len({r for r, _ in pairs})


def test_first_ten_without_a_reranker(spark):
    """All fifteen hits reach the operator; those that are left are numbered anew, also where ranks have gaps."""
    rows = [("a", i, f"c{i}") for i in range(15)] + [("b", 3 * i + 1, f"d{i}") for i in range(12)] + [("c", 7, "e0")]
    hits = spark.createDataFrame(rows, "query_id string, rank0 int, chunk_id string").repartition(3)
    got = reranked(hits, None, 10).collect()
    want = {("a", i, f"c{i}") for i in range(10)} | {("b", i, f"d{i}") for i in range(10)} | {("c", 0, "e0")}
    assert {(r.query_id, r.rank0, r.chunk_id) for r in got} == want and len(got) == 21
    assert all(r.rerank_score is None for r in got) and len(reranked(hits).collect()) == 21


def test_dense_scores_are_made_in_bounded_parts():
    """A task's memory doesn't grow with the rows of a batch times the questions; ties go to the lesser chunk."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x, q = rng.integers(-2, 3, (20_000, 4)).astype(np.float32) + np.float32(0.25), rng.normal(size=(512, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(20_000)), pa.ListArray.from_arrays(np.arange(0, 80_001, 4, dtype=np.int32), x.ravel())], ["chunk_id", "embedding"])
    tracemalloc.start()
    (got,) = dense._best(list(range(512)), q, 5)(iter([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20
    s = np.round(q @ dense._unit(x).T, 9)
    want = np.lexsort((np.broadcast_to(np.arange(20_000), s.shape), -s), axis=1)[:, :5]
    assert got.column("chunk_id").to_numpy().reshape(512, 5).tolist() == want.tolist()


def test_grid_measures_its_columns_once(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import tables

    assert str(tables.grid(F.col("cells"))).count("array_max") <= 2


def test_workers_get_bounded_batches(spark):
    from paperloom.sources import providers

    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    for k in keys:
        spark.conf.unset(k)
    rows = spark.createDataFrame([(["x" * 200_000] * 16,)] * 12, "texts array<string>").coalesce(1)
    got = providers.embedded_batches(rows, lambda texts: [[float(len(t))] for t in texts])
    assert int(spark.conf.get(keys[0])) <= 1000 and int(spark.conf.get(keys[1])) <= 4 << 20
    assert got.filter("size(vectors) = 16 and vectors[15][0] = 200000").count() == 12


def test_chunks_of_one_file_are_made_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from paperloom.operators import tables

    pages = spark.createDataFrame([("f", i, "Table 1 x" if i == 0 else "y") for i in range(40)], "filename string, page_num long, text string")
    found = pages.select("filename", "page_num", F.lit(0).alias("table_idx"), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2"))).alias("cells"))
    rows = tables.page_chunks(pages, found).filter("kind = 0").withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 80 and len({r.task for r in rows}) > 2
    assert sum("(continued)" in r.text for r in rows) == 78
