"""BM25: postings by term and statistics as tables, scoring as joins, exact search that skips blocks of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import words
from paperloom.shared import bounded_batches, written

#: The usual parameters of the Okapi variant: saturation, length weight, floor for terms in over half of the chunks.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Consecutive chunks of a block; terms of a question that are looked up first, to learn what its best hits come to.
BLOCK, FIRST = 64, 4
#: Postings of all questions' terms up to which they are simply all scored, in one pass; beyond, searches skip what can't win.
FULL = 100_000_000
#: Rows of questions' terms that go to all tasks; more meet the postings in a shuffle.
SENT = 500_000
#: Weights of questions' terms times chunks that a worker multiplies at once.
PRODUCT = 1 << 20
#: Bytes of texts whose postings a worker makes at once, or one block's; postings of an Arrow batch.
HELD, SENT_ROWS = 8 << 20, 1 << 16
POSTING, TOP = "term string, block long, chunk_id long, tf int, len int", "top double, avgdl double, n long"
#: Scores that are closer than this aren't told apart when chunks are skipped: sums depend on the order of adding.
SLACK = 1e-6


@dataclass
class LexicalIndex:
    """posting: term, block, chunk_id, tf, len, in order of term, block and chunk within its files. terms: term, df, idf. corpus: one
    row n, words, avgdl. blocks: term, block, top, avgdl, n: the most that a term can weigh in a block's chunks (see block_tops);
    a block is named by its first chunk. Without blocks, searches read all postings of their terms."""

    posting: DataFrame
    terms: DataFrame
    corpus: DataFrame
    blocks: DataFrame | None = None


def terms_of(text: Column | str) -> Column:
    return words(F.lower(F.col(text) if isinstance(text, str) else text))


def postings(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """chunks: chunk_id, text. term, block, chunk_id, tf, len. A text is one row, so its terms are counted where it is: its
    words in order, where runs of equal ones begin, and how long they are; each a column of its own, as what a lambda refers
    to would else be made anew for each word."""
    rows = chunks.select("chunk_id", F.array_sort(terms_of("text")).alias("t")).filter(F.size("t") > 0)
    begins = F.filter(F.transform("t", lambda w, i: F.when((i == 0) | (w != F.get("t", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select("chunk_id", "t", begins.alias("at"))
    runs = F.transform("at", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("t")) - i).alias("tf")))
    rows = rows.select("chunk_id", F.size("t").alias("len"), F.explode(runs).alias("p"))
    return rows.select("p.term", (F.col("chunk_id") - F.pmod("chunk_id", F.lit(block))).alias("block"), "chunk_id", F.col("p.tf").alias("tf"), "len")


def sent(small: DataFrame) -> DataFrame:
    """A written table about the questions: up to SENT rows go to all tasks, so that postings stay where they are."""
    return F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df of all terms: summed up in each task before anything is shuffled, so no posting is moved or kept for it."""
    return chunks.select(F.explode(F.array_distinct(terms_of("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build(chunks: DataFrame, epsilon: float = EPSILON, block: int = BLOCK, asked: DataFrame | None = None, into: Callable[[str], str] | None = None) -> LexicalIndex:
    """chunks: chunk_id, text. The one shuffle brings the texts of a block together; postings, which are several times as large,
    are made, sorted and bounded there, and written once. All statistics and searches read them.

    asked (query_text): an index for these questions only. Counts and idf are of all terms and chunks as ever, but only
    postings of the questions' terms are kept, as nothing else is looked up; they are written where they are made. into: the paths at which
    posting and block stay, so that they are written once."""
    at = lambda name: into(name) if into else None
    if asked is None:
        bounded_batches(chunks.sparkSession)
        rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text")
        rows = rows.repartition(F.col("chunk_id") - F.pmod("chunk_id", F.lit(block))).sortWithinPartitions("chunk_id")
        made = written(rows.select("chunk_id", F.lower("text").alias("text")).mapInArrow(_by_block(block), POSTING + ", " + TOP), "posting", path=at("posting"))
        posting = chunks.sparkSession.read.schema(POSTING).parquet(made.written_path)
        posting.written_path = made.written_path
        blocks = written(made.filter("n is not null").select("term", "block", "top", "avgdl", "n"), "blocks", path=at("block"))
        corpus = posting.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("words")).withColumn("n", F.lit(chunks.count()))
        counts = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    else:
        wanted = written(asked.select(F.explode(terms_of("query_text")).alias("term")).distinct(), "wanted", rows=1)
        posting = written(postings(chunks, block).join(sent(wanted), "term", "left_semi"), "posting")
        corpus = _sizes(chunks)
        counts = term_counts(chunks)
    corpus = written(corpus.select("n", "words"), "corpus", rows=1)
    counts = written(counts, "terms")
    return indexed(posting, counts, corpus, epsilon, block_tops(posting, corpus) if asked is not None else blocks)


def _by_block(block: int, k1: float = K1, b: float = B) -> Callable:
    """Postings of a task's chunks (chunk_id, text in lower case), which are in order and have whole blocks: some blocks at a time, in order of
    term, block and chunk. The first of a term and block says what block_tops does of them; avgdl is that of these blocks."""

    def made(ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        rows, terms = len(ids), pc.ascii_split_whitespace(texts)  # the white space of terms_of
        word, owner = terms.flatten(), np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy())
        some = pc.not_equal(word, "")
        word, owner = word.filter(some).dictionary_encode(), owner[some.to_numpy(zero_copy_only=False)]
        length = np.bincount(owner, minlength=rows)
        if not len(owner):
            return
        number, null = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        number = number - number % block
        order = pc.sort_indices(word.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        key, tf = np.unique(rank[word.indices.to_numpy()] * rows + owner, return_counts=True)
        term, row = key // rows, key % rows
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(term) != 0) | (np.diff(number[row]) != 0) | (np.diff(null[row].astype(np.int8)) != 0)
        begin, avgdl = np.flatnonzero(new), length.sum() / rows
        top, n = np.zeros(len(key)), np.zeros(len(key), np.int64)
        top[begin] = np.maximum.reduceat(tf / (k1 * (1 - b + b * length[row] / avgdl)), begin)
        n[begin] = np.diff(begin, append=len(key))
        columns = [word.dictionary.take(pa.array(order[term])), pa.array(number[row], mask=null[row]), ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(length[row].astype(np.int32))]
        columns += [pa.array(top, mask=~new), pa.array(np.full(len(key), avgdl), mask=~new), pa.array(n, mask=~new)]
        whole = pa.RecordBatch.from_arrays(columns, ["term", "block", "chunk_id", "tf", "len", "top", "avgdl", "n"])
        for lo in range(0, len(key), SENT_ROWS):
            yield whole.slice(lo, SENT_ROWS)

    def size(texts: pa.Array) -> int:
        return pc.sum(pc.binary_length(texts)).as_py() or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            ids.append(batch.column("chunk_id"))
            texts.append(batch.column("text"))
            held += size(texts[-1])
            if held >= HELD:
                i, t = pa.concat_arrays(ids), pa.concat_arrays(texts)
                number = pc.fill_null(i, -1).to_numpy() // block
                last = int(np.flatnonzero(number != number[-1])[-1]) + 1 if (number != number[-1]).any() else 0  # its block may go on
                yield from made(i.slice(0, last), t.slice(0, last))
                ids, texts = [i.slice(last)], [t.slice(last)]
                held = size(texts[0])
        if ids:
            yield from made(pa.concat_arrays(ids), pa.concat_arrays(texts))

    return run


def statistics(chunks: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """terms (term, df, idf) of an index of these chunks, without its postings."""
    return _counted(chunks, epsilon).terms


def _counted(chunks: DataFrame, epsilon: float) -> LexicalIndex:
    """An index without postings."""
    return indexed(None, written(term_counts(chunks), "terms"), written(_sizes(chunks), "corpus", rows=1), epsilon)


def _sizes(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size(terms_of("text")), F.lit(0))), F.lit(0)).alias("words"))


def block_tops(posting: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """term, block, top, avgdl, n. top is the highest tf / (k1 * (1 - b + b * len / avgdl)) of a block's postings; a posting scores
    (k1 + 1) * x / (x + 1) of this x. With another avgdl later on, x grows with it at most."""
    length = corpus.select((F.col("words") / F.greatest("n", F.lit(1))).alias("avgdl"))
    rows = posting.withColumn("avgdl", length.scalar())
    x = F.col("tf") / (k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return rows.groupBy("term", "block").agg(F.max(x).alias("top"), F.max("avgdl").alias("avgdl"), F.count("*").alias("n"))


def indexed(posting: DataFrame | None, counts: DataFrame, corpus: DataFrame, epsilon: float = EPSILON, blocks: DataFrame | None = None) -> LexicalIndex:
    """The index of postings, counts (term, df) and corpus (n, words), which add up over parts of a collection."""
    corpus = corpus.select("n", "words", F.try_divide("words", "n").alias("avgdl"))
    raw = counts.withColumn("n", corpus.select("n").scalar())
    raw = raw.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw_idf"))
    mean = raw.agg(F.avg("raw_idf").alias("mean_idf"))
    floored = raw.withColumn("mean_idf", mean.scalar())
    terms = floored.select("term", "df", F.when(F.col("raw_idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw_idf")).alias("idf"))
    return LexicalIndex(posting, terms, corpus, blocks)


def _saturated(tf: str, length: str, k1: float, b: float) -> Column:
    return F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / F.col("avgdl")))


def _weights(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, weight (idf, as often as the query repeats the term), df."""
    asked = queries.select("query_id", F.explode(terms_of("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return index.terms.select("term", "df", "idf").join(sent(written(asked, "asked", rows=1)), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "df")


def scores(index: LexicalIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """queries: query_id, query_text. One row a query and chunk with a common term: query_id, chunk_id, score. A term
    counts as often as the query repeats it. Postings are dealt by chunk, once; what they come to for each question is added
    up where they are, so that pairs of questions and chunks are never shuffled."""
    weights = written(_weights(index, queries), "weights", rows=1)
    hits = index.posting.repartition("chunk_id").join(sent(weights), "term").withColumn("avgdl", index.corpus.select("avgdl").scalar())
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * _saturated("tf", "len", k1, b)).alias("score"))


def best(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each query in the order, with place from 1. The limit is on the row number itself, so that each task
    passes on n rows a query at most, and a query's rows needn't meet in one task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("place") <= n)


def ranked(scored: DataFrame, n: int, score: str = "score", least: float | None = None) -> DataFrame:
    """The n best of each query, ranks from 0; equal scores in chunk_id order. Scores count as equal at nine digits, as
    the last ones depend on the order in which terms are added up. least: kept only from this score on."""
    out = best(scored, n, F.desc(F.round(score, 9)), "chunk_id").withColumn("rank0", F.col("place") - 1).drop("place")
    return out if least is None else out.filter(F.col(score) >= least)


@dataclass
class Search:
    """A pruned search: scored (query_id, chunk_id, score) holds the n best of each query and some more; asked (query_id, term,
    block, n) are all blocks of the queries' terms, read those that were looked into for candidates."""

    scored: DataFrame
    asked: DataFrame
    read: DataFrame


def searched(index: LexicalIndex, queries: DataFrame, n: int, first: int = FIRST) -> Search:
    """Each query's weightiest terms are looked up first; the n chunks that they favour are scored in full, and the n best
    reach what the least of those scores. The query's lightest terms, as long as they can't come to that together, bring no
    candidate: those come from the blocks of the other terms, and only from blocks whose highest weights, with all light
    terms, can reach it. A candidate whose heavy terms fall too far short is dropped, the others' light terms are added.
    Nothing that could be among the n best is left out."""
    avgdl = index.corpus.select("avgdl").scalar()
    of_query = Window.partitionBy("query_id")
    blocks = index.blocks.withColumnsRenamed({"avgdl": "then"}).withColumn("x", F.col("top") * F.greatest(avgdl / F.col("then"), F.lit(1.0)))
    blocks = written(blocks.drop("then", "top").repartition("block"), "tops")
    most = F.greatest(F.col("weight") * (K1 + 1) * F.col("x") / (F.col("x") + 1), F.lit(0.0))
    weights = written(_weights(index, queries), "weights", rows=1)
    asked = blocks.join(sent(weights), "term").select("query_id", "term", "block", "n", most.alias("most"))
    limits = weights.join(asked.groupBy("query_id", "term").agg(F.max("most").alias("most")), ["query_id", "term"])
    limits = written(limits, "limits", rows=1)  # a row a query and term
    score = (F.col("weight") * _saturated("tf", "len", K1, B)).alias("score")

    def looked_up(terms: DataFrame, on: list[str]) -> DataFrame:
        hits = index.posting.join(sent(terms), on).withColumn("avgdl", avgdl)
        return hits.select("query_id", "chunk_id", "block", score).groupBy("query_id", "chunk_id", "block").agg(F.sum("score").alias("score"))

    firsts = written(best(limits, first, F.desc("most"), "term").select("query_id", "term", "weight"), "firsts", rows=1)
    favoured = written(best(looked_up(firsts, ["term"]), n, F.desc("score"), "chunk_id").select("query_id", "chunk_id", "block"), "favoured", rows=1)
    pairs = written(favoured.join(limits.select("query_id", "term", "weight"), "query_id"), "pairs", rows=1)
    reached = looked_up(pairs, ["term", "block", "chunk_id"]).groupBy("query_id").agg(F.when(F.count("*") == n, F.min("score") - SLACK).alias("reached"))
    light = F.sum("most").over(of_query.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    split = limits.join(reached, "query_id", "left").withColumn("light", F.coalesce(light < F.col("reached"), F.lit(False)))
    split = split.withColumn("rest", F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))).over(of_query), F.lit(0.0)))
    split = written(split, "split", rows=1)
    heavy = split.filter("not light").select("query_id", "term", "weight", "reached", "rest")
    parts = blocks.join(sent(heavy), "term").select("query_id", "term", "block", "n", "reached", "rest", most.alias("most"))
    # by block from here on: which questions a block can still win, and what its chunks come to for those
    fits = parts.repartition("block").groupBy("query_id", "block").agg((F.sum("most") + F.max("rest")).alias("bound"), F.max("reached").alias("reached"))
    fits = fits.filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached"))).select("query_id", "block")
    open_ = written(fits.groupBy("block").agg(F.collect_set("query_id").alias("open")), "open")
    terms = split.select("query_id", "term", "weight", "light", "reached", "rest")
    hits = index.posting.repartition("block").join(open_, "block").join(sent(terms), "term").filter(F.array_contains("open", F.col("query_id"))).withColumn("avgdl", avgdl)
    hits = hits.select("query_id", "chunk_id", "block", "light", "reached", "rest", score)
    found = hits.groupBy("query_id", "block", "chunk_id").agg(F.sum("score").alias("score"), F.sum(F.when(~F.col("light"), F.col("score"))).alias("heavy"), F.max("reached").alias("reached"), F.max("rest").alias("rest"))
    found = found.filter(F.col("heavy").isNotNull() & (F.col("reached").isNull() | (F.col("heavy") + F.col("rest") >= F.col("reached"))))
    read = parts.join(fits, ["query_id", "block"])
    return Search(found.select("query_id", "chunk_id", "score"), asked.select("query_id", "term", "block", "n"), read.select("query_id", "term", "block", "n"))


def bm25_topk(index: LexicalIndex, queries: DataFrame, n: int, full: int | None = None) -> DataFrame:
    """The n best chunks of a query that score above zero: query_id, rank0, chunk_id, score. The same whether all postings of
    the queries' terms are scored, as where they are at most `full` (FULL) or the index has no blocks, or a pruned search is."""
    few = index.blocks is None or (_weights(index, queries).agg(F.sum("df")).first()[0] or 0) <= (FULL if full is None else full)
    return ranked(scores(index, queries) if few else searched(index, queries, n).scored, n).filter("score > 0").select("query_id", "rank0", "chunk_id", "score")


def stated_topk(chunks: DataFrame, queries: DataFrame, n: int, epsilon: float = EPSILON) -> DataFrame:
    """The rows of bm25_topk for one stated set of questions, in one pass over the texts once idf is known: a chunk's score is
    made where its text is and each task passes on n chunks a question, so that no posting is written or moved. Questions of over
    SENT terms together, and chunks that repeat a number, whose scores have to be added up, take an index of the questions' terms."""
    counted = _counted(chunks, epsilon)
    weights = written(_weights(counted, queries).select("query_id", "term", "weight"), "weights", rows=1)
    whole = chunks.groupBy("chunk_id").count().filter("count > 1 or chunk_id is null").isEmpty()
    if not whole or weights.limit(SENT + 1).count() > SENT:
        return bm25_topk(build(chunks, epsilon, asked=queries), queries, n)
    bounded_batches(chunks.sparkSession)
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), terms_of("text").alias("terms"))
    table, of = weights.toArrow(), weights.schema["query_id"].dataType.simpleString()
    if not table.num_rows:
        return chunks.sparkSession.createDataFrame([], f"query_id {of}, rank0 int, chunk_id long, score double")
    best_ = rows.mapInArrow(_in_place(table, counted.corpus.first().avgdl, n), f"query_id {of}, chunk_id long, score double")
    return ranked(best_, n).select("query_id", "rank0", "chunk_id", "score")


def _in_place(weights: pa.Table, avgdl: float, n: int, k1: float = K1, b: float = B) -> Callable:
    """The n best of each question among a task's chunks (chunk_id, terms) that score above zero. Of the scores that are made at a
    time only what reaches a question's n-th best so far is looked at again."""
    weights = weights.sort_by([("term", "ascending"), ("query_id", "ascending")])
    asked, known = (weights.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
    ids, vocabulary = asked.dictionary, known.dictionary
    asked, known, weight = asked.indices.to_numpy(), known.indices.to_numpy(), weights.column("weight").to_numpy()
    begin = np.searchsorted(known, np.arange(len(vocabulary) + 1))  # a term's weights lie together
    size = max(1, PRODUCT // len(weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(ids), -np.inf)
        owner, score, key, chunk = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        for batch in (whole.slice(lo, size) for whole in batches for lo in range(0, whole.num_rows, size)):
            length = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy().astype(np.int64)
            term = pc.index_in(batch.column("terms").flatten(), value_set=vocabulary)
            row = np.repeat(np.arange(len(length)), length)[term.is_valid().to_numpy(zero_copy_only=False)]
            posting, tf = np.unique(row * len(vocabulary) + term.drop_null().to_numpy(), return_counts=True)
            row, term = posting // len(vocabulary), posting % len(vocabulary)
            x = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avgdl))
            times = begin[term + 1] - begin[term]
            at = np.arange(times.sum()) + np.repeat(begin[term] - (np.cumsum(times) - times), times)
            pair = np.repeat(row, times) * len(ids) + asked[at]
            new = np.bincount(pair, weight[at] * np.repeat(x, times), len(length) * len(ids)).reshape(len(length), len(ids))
            rounded = np.round(new, 9)
            c, q = np.nonzero((new > 0) & (rounded >= least))
            if not len(q):
                continue
            owner, score, key = np.concatenate([owner, q]), np.concatenate([score, new[c, q]]), np.concatenate([key, rounded[c, q]])
            chunk = np.concatenate([chunk, batch.column("chunk_id").to_numpy()[c]])
            order = np.lexsort((chunk, -key, owner))
            place = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
            last, order = order[place == n - 1], order[place < n]
            least[owner[last]] = key[last]
            owner, score, key, chunk = owner[order], score[order], key[order], chunk[order]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(chunk), pa.array(score)], ["query_id", "chunk_id", "score"])

    return run
