"""Numbering without moving texts, postings by term, and the pruned search against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import chunking, lexical, postprocess
from paperloom.plans import queries as plans
from paperloom.shared import gathered


def corpus(spark, seed, n=900):
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(3000)]
    weight = [1 / (i + 1) for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocab, weight, k=rng.choice([0, 3, 30, 80])))) for i in range(n)]
    asked = [(q, " ".join(rng.choices(vocab, weight, k=6) + rng.choices(vocab, k=4))) for q in range(12)]
    asked += [(20, "t0 t0 t1"), (21, "nothing here"), (22, ""), (23, rows[5][1] or "t9"), (24, "t2999 t0")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5), spark.createDataFrame(asked, "query_id long, query_text string")


def top(rows):
    return sorted((r.query_id, r.rank0, r.chunk_id, round(r.score, 8)) for r in rows.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_search_is_exact(spark, seed):
    chunks, asked = corpus(spark, seed)
    index = lexical.build(chunks, block=16)
    for n in (1, 7):
        assert top(lexical.bm25_topk(index, asked, n, full=0)) == top(lexical.bm25_topk(index, asked, n)) != []
    search = lexical.searched(index, asked, 1)
    all_, read = (df.agg(F.sum("n")).first()[0] for df in (search.asked, search.read))
    scored = lexical.scores(index, asked).count()
    assert read < 0.6 * all_ and search.scored.count() < 0.5 * scored  # postings read, and chunks scored


def test_pruned_search_as_a_collection_grows(spark):
    """Blocks of an older part were bounded at another mean length."""
    long_, asked = corpus(spark, 5, 300)
    short = long_.select((F.col("chunk_id") + 304).alias("chunk_id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("text"))
    for a, b in ((long_, short), (short, long_)):
        parts, whole = [lexical.build(x, block=16) for x in (a, b)], lexical.build(a.unionByName(b), block=16)
        both = lexical.LexicalIndex(parts[0].posting.unionByName(parts[1].posting), whole.terms, whole.corpus, parts[0].blocks.unionByName(parts[1].blocks))
        assert top(lexical.bm25_topk(both, asked, 5, full=0)) == top(lexical.bm25_topk(whole, asked, 5))


def test_postings_are_counts_in_order(spark):
    rows = [(0, "b a B"), (1, None), (2, "  "), (67, "a c"), (-3, "x X x")]
    got = lexical.postings(spark.createDataFrame(rows, "chunk_id long, text string"), 64).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 1, 3), ("a", 64, 67, 1, 2), ("b", 0, 0, 2, 3), ("c", 64, 67, 1, 2), ("x", -64, -3, 3, 3)]
    index = lexical.build(spark.createDataFrame(rows, "chunk_id long, text string"))
    assert (index.corpus.first().n, index.corpus.first().words) == (5, 8)
    empty = lexical.build(spark.createDataFrame([], "chunk_id long, text string"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    assert lexical.bm25_topk(empty, asked, 3).count() == 0 == lexical.bm25_topk(empty, asked, 3, full=0).count()


@pytest.mark.parametrize("sent", [100_000, 0])
def test_numbers_from_counts(spark, monkeypatch, sent):
    from paperloom.operators import numbering

    monkeypatch.setattr(numbering, "SENT", sent)
    rng = random.Random(3)
    rows = [(f"f{rng.randrange(4)}", p, " ".join(["w"] * rng.choice([0, 1, 400, 401, 1500]))) for p in range(60)] + [(None, 1, "a b"), ("f1", None, "c d"), ("f9", 1, None)]
    pages = spark.createDataFrame(rows, "filename string, page_num long, text string").repartition(7)
    order = ["filename", "page_num", "chunk_seq"]
    got = sorted(map(tuple, chunking.numbered_text_chunks(pages, start=5).select("chunk_id", *order, "text").collect()), key=repr)
    assert got == sorted(map(tuple, chunking.numbered(chunking.text_chunks(pages), start=5).select("chunk_id", *order, "text").collect()), key=repr)
    twice = chunking.numbered_text_chunks(pages.unionByName(pages)).select("chunk_id").collect()  # rows repeat their pages
    assert sorted(r.chunk_id for r in twice) == list(range(2 * len(got)))
    plan = chunking.numbered_text_chunks(pages)._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (sent > 0) or "BroadcastNestedLoopJoin" not in plan


def test_index_for_stated_questions(spark):
    """Only postings of the questions' terms are kept; hits and statistics are those of the whole index, and no pair of a question
    and a chunk is shuffled for a score."""
    chunks, asked = corpus(spark, 3)
    index, whole = lexical.build(chunks, block=16, asked=asked), lexical.build(chunks, block=16)
    terms = {t for r in asked.collect() for t in r.query_text.lower().split()}
    assert {r.term for r in index.posting.select("term").distinct().collect()} <= terms and index.posting.count() < whole.posting.count()
    for full in (None, 0):
        assert top(lexical.bm25_topk(index, asked, 5, full)) == top(lexical.bm25_topk(whole, asked, 5)) != []
    idf = [sorted((r.term, r.df, round(r.idf, 9)) for r in t.collect()) for t in (index.terms, whole.terms, lexical.statistics(chunks))]
    assert idf[0] == idf[1] == idf[2]
    plan = lexical.scores(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" in plan and "hashpartitioning(query_id" not in plan


@pytest.mark.parametrize("product", [1 << 20, 1])
def test_stated_questions_in_one_pass(spark, monkeypatch, product):
    """The rows of an index, from the texts as they are: no posting is written. Copies tie in chunk order."""
    chunks, asked = corpus(spark, 4)
    copies = chunks.unionByName(chunks.select((F.col("chunk_id") + 1000).alias("chunk_id"), "text")).unionByName(spark.createDataFrame([(5000, None), (5001, " ")], "chunk_id long, text string")).repartition(3)
    monkeypatch.setattr(lexical, "PRODUCT", product)
    for n in (1, 7):
        with gathered() as made:
            got = top(lexical.stated_topk(copies, asked, n))
        assert got == top(lexical.bm25_topk(lexical.build(copies), asked, n)) != []
        assert not any("/posting-" in path for path in made)
    nothing = spark.createDataFrame([(1, "unheard of"), (2, None)], "query_id long, query_text string")
    assert lexical.stated_topk(chunks, nothing, 3).count() == 0 == lexical.stated_topk(chunks.limit(0), asked, 3).count()


@pytest.mark.parametrize("odd", ["repeated", "null", "many"])
def test_stated_questions_by_an_index(spark, monkeypatch, odd):
    """Scores of chunks that repeat a number are added up; more weights than are sent meet the postings in a shuffle."""
    chunks, asked = corpus(spark, 6, 200)
    if odd == "many":
        monkeypatch.setattr(lexical, "SENT", 3)
    else:
        chunks = chunks.withColumn("chunk_id", F.expr("chunk_id div 2" if odd == "repeated" else "nullif(chunk_id, 7)"))
    key = lambda rows: sorted((r.query_id, r.rank0, -1 if r.chunk_id is None else r.chunk_id, round(r.score, 8)) for r in rows.collect())
    assert key(lexical.stated_topk(chunks, asked, 5)) == key(lexical.bm25_topk(lexical.build(chunks), asked, 5)) != []


def test_texts_stay_where_they_are(spark):
    """Hits are few and go to the texts, also where the plan can't tell that they are: nothing but hits is shuffled for a join."""
    data, queries = "/root/testdata/sf0.001", plans.queries()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("q_dedup_text", "q_multi_query_rrf", "q_rerank_scored"):
            with gathered() as made:
                plan = queries[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
            assert not any("/posting-" in path for path in made)
            assert "rightHint=(strategy=broadcast)" in plan, name
        hits = spark.createDataFrame([(1, 0, "s", "text", "a")], "query_id long, rank0 int, source string, chunk_type string, text string")
        rows = spark.createDataFrame([(1, "s", "text", "a"), (2, "t", "text", "b")], "chunk_id long, source string, chunk_type string, text string")
        out = postprocess.sentence_windows(hits, rows)
        assert "LeftSemi, BuildRight" in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "") and [r.window_text for r in out.collect()] == ["a"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("held", [8 << 20, 1])
def test_postings_are_made_where_texts_are(spark, monkeypatch, held):
    """An index is the postings and block tops as JVM expressions make them, whatever is held at once; no posting is shuffled, and
    only one row a term and block."""
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "SENT_ROWS", 100)
    chunks, _ = corpus(spark, 7, 300)
    odd = [(-3, "x X x"), (-70, "y"), (1000, "é\x0bZ中\x1c \U0001f600\x85É\u00a0\r\fz"), (1001, None), (None, "t0 n n"), (299, "t0 again t0")]
    chunks = chunks.unionByName(spark.createDataFrame(odd, "chunk_id long, text string"))
    index = lexical.build(chunks, block=16)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = lexical.postings(chunks, 16)
    assert rows(index.posting) == rows(want.select(*index.posting.columns)) != []
    assert rows(index.blocks.select("term", "block", "n")) == rows(want.groupBy("term", "block").agg(F.count("*")))
    tops = index.blocks.withColumnRenamed("avgdl", "then").join(want, ["term", "block"])
    x = F.col("tf") / (lexical.K1 * (1 - lexical.B + lexical.B * F.col("len") / F.col("then")))
    assert tops.groupBy("term", "block", "top").agg(F.max(x).alias("x")).filter("abs(x - top) > 1e-12").isEmpty()
    assert rows(index.terms.select("term", "df")) == rows(want.groupBy("term").agg(F.count("*")))
    assert (index.corpus.first().n, index.corpus.first().words) == (chunks.count(), want.agg(F.sum("tf")).first()[0])
