"""The engine: ingest pages into a store, answer batches of questions from it. A batch of questions is one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import clean_answer, has_followup_signal, query_complexity
from paperloom.functions.vectors import blended, normalised
from paperloom.operators import chat, chunking, dense, fusion, ingest, lexical, postprocess, tables
from paperloom.shared import delete, discard, gathered, written
from paperloom.sources import providers
from paperloom.sources.batchlog import BatchLog
from paperloom.sources.commits import create_if_absent, place
from paperloom.sources.pages import raw_tables
from paperloom.sources.store import Store

#: Chunks of a batch of an ingest, and of several small ones that are embedded by one job: what a break costs at most.
INGEST_BATCH = 100_000
#: Chunks of one batch that are staged, or embedded, by one task.
PIECE = 1_024
#: Hits of the question and of each other wording, weights of their lists, hits that are merged and shown.
PRIMARY, VARIANT, PRIMARY_WEIGHT, VARIANT_WEIGHT, MERGED, SHOWN = 20, 8, 3.0, 0.5, 15, 10
NO_HITS = "No document matches this question. Try other words."
NO_ANSWER = "The model gave no answer. Ask again or in other words."


def hybrid_search(chunks: DataFrame, vectors: DataFrame | None, index: lexical.LexicalIndex | None, queries: DataFrame, n: int) -> DataFrame:
    """queries: query_id, query_text, embedding. The n best hits of both indexes together, with the chunk's columns:
    query_id, rank0, chunk_id, filename, page, source, chunk_type, text, distance, rrf_score. Without one of the
    indexes, the other's hits alone. Each side brings 2n candidates."""
    empty = "query_id long, rank0 int, chunk_id long, score double"
    spark = chunks.sparkSession
    d = dense.dense_topk(vectors, queries, 2 * n) if vectors is not None else spark.createDataFrame([], empty)
    x = lexical.bm25_topk(index, queries, 2 * n) if index is not None else spark.createDataFrame([], empty)
    hits = fusion.hybrid(d, x, n)
    return hits.join(chunks.select("chunk_id", "filename", F.col("page_num").cast("string").alias("page"), "source", "chunk_type", "text"), "chunk_id")


#: What a store keeps of a chunk, in the order that numbers it.
ORDER = ("filename", "page_num", "kind", "table_idx", "chunk_seq")
CHUNK = (*ORDER, "source", "chunk_type", "text")
_KINDS = {"page_num": T.LongType(), "kind": T.IntegerType(), "table_idx": T.IntegerType(), "chunk_seq": T.IntegerType()}
CHUNK_SCHEMA = T.StructType([T.StructField("chunk_id", T.LongType()), *[T.StructField(c, _KINDS.get(c, T.StringType())) for c in CHUNK]])
ENDS = "batch long, files long, file string, first long, last long"
VECTOR_SCHEMA = T.StructType([T.StructField("chunk_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def with_vectors(rows: DataFrame, vectors: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the vector (vectors: text, embedding) of a column's text; null without one."""
    return rows.join(vectors.select(F.col("text").alias(column), F.col("embedding").alias(name)), column, "left")


def question_vectors(asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """asked: query_id, query_text, expanded, hyde. query_id, query_text (as expanded) and embedding: the expanded
    question's vector, else the question's own, blended with the hypothetical passage's where there is one."""
    rows = with_vectors(with_vectors(with_vectors(asked, vectors, "query_text", "q"), vectors, "expanded", "e"), vectors, "hyde", "h")
    best = F.coalesce("e", "q").cast("array<double>")
    return rows.select("query_id", F.col("expanded").alias("query_text"), F.when(F.col("h").isNotNull(), blended(best, F.col("h"))).otherwise(best).alias("embedding"))


def question_texts() -> Column:
    """What is embedded of a question, in one call: itself, as expanded, the passage, two other wordings; null where there is
    no such text or it is the question itself."""
    hyde = F.when(F.col("hyde") != "", F.col("hyde"))
    return F.array(F.col("query_text"), F.when(F.col("expanded") != F.col("query_text"), F.col("expanded")), hyde, F.get("variants", F.lit(0)), F.get("variants", F.lit(1)))


def first_vector() -> Column:
    """Of vectors in the order of question_texts: the expanded question's, else the question's own, blended with the
    passage's where there is one."""
    at = lambda i: F.get("vectors", F.lit(i))
    best = F.coalesce(at(1), at(0)).cast("array<double>")
    return F.when(at(2).isNotNull(), blended(best, at(2))).otherwise(best)


def _of_texts(chunks: DataFrame) -> DataFrame:
    """Chunks of pages without tables, with the columns of tables.page_chunks."""
    return chunks.withColumns({"kind": F.lit(1), "table_idx": F.lit(0)})


@dataclass
class Engine:
    """embed, complete, rerank: providers. tries, per_second: how often a call is made before it counts as failed, and
    calls a second of each provider in all. batch: chunks of a batch of an ingest. keep_answers: whether a model's answers are
    kept with the store, so that a prompt that was answered is never sent again."""

    spark: SparkSession
    path: str
    embed: providers.Embed | None = None
    complete: providers.Complete | None = None
    rerank: providers.Rerank | None = None
    lexical: bool = True
    tries: int = 3
    delay: float = 1.0
    per_second: float | None = None
    batch: int = INGEST_BATCH
    keep_answers: bool = False

    @property
    def store(self) -> Store:
        return Store(self.spark, self.path)

    def _service(self, call):
        lanes = providers.lanes_for(self.spark.sparkContext.defaultParallelism, self.per_second)
        return None if call is None else providers.Service(call, self.tries, self.delay, self.per_second, lanes)

    def _answers(self) -> providers.Answers | None:
        if self.complete is None:
            return None
        return providers.Answers(self.spark, self._service(self.complete), f"{self.store.path}/answers" if self.keep_answers else None)

    def chunks(self, pages: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
        """Chunks (CHUNK) of pages: filename, page_num, text and, where an extractor found some, tables. fallback: the
        tables of the next tier (filename, page_num, table_idx, cells, extractor) for pages that poor_pages names."""
        pages = chunking.limited_pages(pages)
        if fallback is None and "tables" not in pages.columns:
            return _of_texts(chunking.text_chunks(pages))
        if "tables" not in pages.columns:
            pages = pages.withColumn("tables", F.array().cast("array<array<array<string>>>"))
        raw = raw_tables(pages).drop("page_text").withColumn("extractor", F.lit("page"))
        return tables.page_chunks(pages, tables.accepted(raw, fallback))

    def ingest(self, pages: DataFrame, vectors: DataFrame | None = None, dim: int = 0, fallback: DataFrame | None = None, fresh: bool = False) -> dict:
        """pages: filename, page_num, text and, if there are any, tables. vectors: text, embedding, where they are at
        hand. An ingest that broke off is finished first. Files that the store has are left out; the rest is chunked once, then
        embedded batch by batch, each noted when it is done, then indexed, and added to what is there: chunks, vectors and
        postings are written for new files only, counts of terms are added up. fresh: begin with an empty version."""
        if fresh:
            self.store.reset()
        self.resume()
        self.finish(vectors, fresh)
        old = self.store.load() if self.store.exists() else {}
        if "chunk" in old:
            done = old["chunk"].select("filename").distinct()
            pages = pages.join(done, "filename", "left_anti")
            fallback = fallback.join(done, "filename", "left_anti") if fallback is not None else None
        saved = self._finished(self.staged(pages, fallback, dim), vectors)
        self.store.clear_progress()
        return saved

    def staged(self, pages: DataFrame, fallback: DataFrame | None = None, dim: int = 0) -> BatchLog:
        """The pages' chunks, numbered from 0 and written by batch where the store will have them; the log says so."""
        folder, parts = self.store.new_folder(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with gathered() as steps:
            if fallback is None and "tables" not in pages.columns:
                chunks = _of_texts(chunking.numbered_text_chunks(chunking.limited_pages(pages)))
            else:
                chunks = chunking.numbered(self.chunks(pages, fallback), *ORDER)
            chunks = chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA.fields])
            # numbers have no gaps, so equal spans of them are equal tasks; a small batch is one task's and one file
            task = F.pmod(F.floor(F.col("chunk_id") / min(self.batch, PIECE)), F.lit(parts)).cast("int")
            dealt = chunks.withColumn("batch", F.floor(F.col("chunk_id") / self.batch)).repartitionById(parts, task)
            dealt.sortWithinPartitions("batch", "chunk_id").write.partitionBy("batch").parquet(self.store.folder("chunk", folder))
        for path in steps:
            delete(self.spark, path)
        n = self._staged_chunks(folder).count()
        log = BatchLog(self.spark, self.store.path, folder)
        log.begin(n, self.batch, dim)
        return log

    def _staged_chunks(self, folder: str, batches: list[int] | None = None) -> DataFrame:
        path = self.store.folder("chunk", folder)
        paths = [path] if batches is None else [f"{path}/batch={k}" for k in batches]
        return self.spark.read.schema(CHUNK_SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)

    def finish(self, vectors: DataFrame | None = None, forget: bool = False) -> list[str]:
        """Go on with ingests that broke off after their chunks were staged: only batches without an entry in the log are
        embedded. forget: leave them; they are never part of a version then. Gives the folders that were finished."""
        old = {f for n in self.store.versions() for fs in json.loads(self.store.manifest(n)["folders"]).values() for f in fs}
        out = []
        for folder in BatchLog.folders(self.spark, self.store.path):
            if folder not in old and not self.store.exists(f"ingest/{folder}/left.json"):
                if forget:
                    create_if_absent(self.spark, f"{self.store.path}/ingest/{folder}/left.json", "{}")
                else:
                    self._finished(BatchLog(self.spark, self.store.path, folder), vectors)
                    out.append(folder)
        return out

    def embed_batch(self, log: BatchLog, batch: int, vectors: DataFrame | None = None) -> dict:
        """embed_batches for one batch."""
        return self.embed_batches(log, [batch], vectors)[0]

    def embed_batches(self, log: BatchLog, batches: list[int], vectors: DataFrame | None = None) -> list[dict]:
        """Write the batches' vectors, each to its own folder (what a broken attempt left there goes), and give their entries in
        the log. The number of jobs doesn't grow with the number of batches."""
        plan = log.plan()
        size, path = plan["size"], self.store.folder("vector", log.folder)
        batch = F.floor(F.col("chunk_id") / size)
        rows = chunking.embed_texts(self._staged_chunks(log.folder, batches))
        if vectors is not None:
            found = with_vectors(rows.select("chunk_id", "embed_text"), vectors, "embed_text", "embedding")
        elif self.embed is not None:
            # a call's texts are of one piece of one batch
            per = -(-size // PIECE)
            own = rows.withColumn("piece", (batch * per + F.floor(F.pmod("chunk_id", F.lit(size)) / PIECE)).cast("long"))
            tasks = min(len(batches) * per, 4 * self.spark.sparkContext.defaultParallelism)
            calls = providers.embedded_batches(chunking.piece_rows(own, "embed_text", tasks).select("ids", "texts"), self._service(self.embed))
            found = calls.select(F.explode(F.arrays_zip("ids", "vectors")).alias("z")).select(F.col("z.ids").alias("chunk_id"), F.col("z.vectors").alias("embedding"))
        else:
            found = rows.select("chunk_id", F.lit(None).cast("array<float>").alias("embedding"))
        none = self.spark.createDataFrame([], VECTOR_SCHEMA)
        good = dense.add_vectors(none, found, plan["dim"]) if plan["dim"] else found.filter("embedding is not null").select("chunk_id", normalised("embedding").alias("embedding"))
        for k in batches:
            fs, old = place(self.spark, f"{path}/batch={k}")
            fs.delete(old, True)
        if len(batches) == 1:
            good.write.parquet(f"{path}/batch={batches[0]}")
        else:
            good = good.withColumn("batch", batch)
            together = vectors is None and self.embed is not None and not self.per_second  # a small batch was one task's
            (good if together else good.repartition("batch")).write.mode("append").partitionBy("batch").parquet(path)
        there = [p for k in batches if (p := f"{path}/batch={k}") and (at := place(self.spark, p))[0].exists(at[1])]
        read = self.spark.read.schema(VECTOR_SCHEMA)
        made = read.parquet(*there) if there else none
        n_vectors = dict(made.groupBy(batch.alias("batch")).count().collect())
        out = []
        for r in self._ends(log).filter(F.col("batch").isin(batches)).orderBy("batch").collect():
            first = r.batch * size
            last = min(first + size, plan["n_chunks"]) - 1
            n, vectors_here = last - first + 1, n_vectors.get(r.batch, 0)
            out.append({"batch": r.batch, "first_chunk": first, "last_chunk": last, "n_chunks": n, "n_vectors": vectors_here, "n_skipped": n - vectors_here, "n_files_ended": r.files - (r.last > last), "current_file": r.file, "chunks_in_current": last - r.first + 1})
        return out

    def _ends(self, log: BatchLog) -> DataFrame:
        """batch, files (how many it has a part of), file (that it ends in), first and last chunk of that file. A row a batch, made
        once for all batches of what was staged, so that no batch has to look through the others' chunks."""
        name, batch = f"append={log.folder}", F.floor(F.col("chunk_id") / log.plan()["size"])
        if self.store.exists(f"ends/{name}/_SUCCESS"):
            return self.spark.read.schema(ENDS).parquet(f"{self.store.path}/ends/{name}")
        parts = self._staged_chunks(log.folder).groupBy(batch.alias("batch"), "filename").agg(F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
        parts = written(parts, "parts")
        ends = written(parts.groupBy("batch").agg(F.count("*").alias("files"), F.max_by("filename", "last").alias("file")), "ends", rows=1)
        files = parts.groupBy(F.col("filename").alias("f")).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        told = files.join(F.broadcast(ends), F.col("f").eqNullSafe(F.col("file"))).select("batch", "files", "file", "first", "last")
        out = written(told, "ends", rows=1, path=f"{self.store.path}/ends/{name}")
        discard(parts, ends)
        return out

    def _finished(self, log: BatchLog, vectors: DataFrame | None) -> dict:
        pending, done, size = log.pending(), len(log.done()), log.plan()["size"]
        while pending:
            # half as many as are done, so that a break costs a part of what it had done, and no more than INGEST_BATCH chunks
            lot = pending[: max(1, min(done // 2, INGEST_BATCH // size))]
            for entry in self.embed_batches(log, lot, vectors):
                log.commit(entry)
            pending, done = pending[len(lot) :], done + len(lot)
        with gathered() as steps:
            saved = self._indexed(log)
        for path in steps:
            delete(self.spark, path)
        return saved

    def _indexed(self, log: BatchLog) -> dict:
        built = lexical.build(self._staged_chunks(log.folder), into=lambda name: self.store.folder(name, log.folder))
        if not log.plan()["n_chunks"]:
            self.spark.createDataFrame([], VECTOR_SCHEMA).write.mode("overwrite").parquet(self.store.folder("vector", log.folder))

        def terms(old: dict[str, DataFrame]) -> dict[str, DataFrame]:
            counts, corpus = built.terms.select("term", "df"), built.corpus.select("n", "words")
            if "terms" in old:
                counts = counts.unionByName(old["terms"].select("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
                corpus = corpus.unionByName(old["corpus"].select("n", "words")).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
            whole = lexical.indexed(built.posting, counts, corpus)
            return {"terms": whole.terms, "corpus": whole.corpus}

        schemas = {"chunk": CHUNK_SCHEMA, "vector": VECTOR_SCHEMA, "posting": built.posting.schema, "block": built.blocks.schema}
        return self.store.commit(log.folder, schemas, log.plan()["dim"], tuple(schemas), terms)

    def resume(self) -> str:
        """What an ingest that broke off left, put right from its progress notes: a store with more vectors than were
        noted is cut to those, one with fewer is cleared. Without notes nothing is done."""
        notes = self.store.load_progress()
        if not notes or not self.store.exists() or not self.store.folders():
            return "nothing"
        got = self.store.load()
        what, n = ingest.resume_decision(got["vector"].count(), notes["total_vectors_at_save"])
        if what == "discard":
            self.store.clear()
        elif what == "truncate":
            chunks = ingest.truncated(got["chunk"], n)
            built = lexical.build(chunks)
            dim = self.store.manifest()["embedding_dim"]
            self.store.save({"chunk": chunks, "vector": ingest.truncated(got["vector"], n), "posting": built.posting, "block": built.blocks, "terms": built.terms, "corpus": built.corpus}, dim)
        return what

    def skipped(self, pages: DataFrame) -> DataFrame:
        """What read_pages left out, by reason."""
        return ingest.skip_report(pages.select("filename", "page_num", F.col("status").alias("reason")))

    def _search(self, stored: dict[str, DataFrame], queries: DataFrame, n: int) -> DataFrame:
        index = lexical.LexicalIndex(stored["posting"], stored["terms"], stored["corpus"], stored.get("block")) if self.lexical else None
        return hybrid_search(stored["chunk"], stored["vector"], index, queries, n)

    def search(self, questions: DataFrame, history: DataFrame | None = None) -> dict[str, DataFrame]:
        """questions: query_id, query_text and, for histories, conv_id. Gives `questions` (with complexity, expanded,
        variants), `hits`, `conflicts`, `contexts` and `sources`."""
        stored = self.store.load()
        asked = questions.withColumn("complexity", query_complexity("query_text"))
        if history is not None and "conv_id" in questions.columns:
            asked = asked.join(chat.summaries(history), "conv_id", "left")
        else:
            asked = asked.withColumn("summary", F.lit(None).cast("string"))
        # written: what a model or an embedder says is asked for once, whatever reads it
        asked = providers.expanded(asked, self._service(self.complete), self._answers())
        texts = asked.withColumn("texts", question_texts())
        embedded = providers.embedded_batches(texts, self._service(self.embed)) if self.embed else texts.withColumn("vectors", F.lit(None).cast("array<array<float>>"))
        asked = written(embedded.drop("texts"), "asked", rows=1)
        first = asked.select("query_id", F.col("expanded").alias("query_text"), first_vector().alias("embedding"))
        lists = [self._search(stored, first, PRIMARY).withColumns({"list_seq": F.lit(0), "weight": F.lit(PRIMARY_WEIGHT)})]
        if self.complete is not None:
            for k in range(2):
                other = asked.filter(F.size("variants") > k).select("query_id", F.get("variants", F.lit(k)).alias("query_text"), F.get("vectors", F.lit(3 + k)).alias("embedding"))
                lists.append(self._search(stored, other, VARIANT).withColumns({"list_seq": F.lit(k + 1), "weight": F.lit(VARIANT_WEIGHT)}))
            hits = fusion.weighted(reduce(DataFrame.unionByName, lists), MERGED).drop("fusion_key", "list_seq")
        else:
            hits = lists[0].drop("list_seq", "weight")
        hits = postprocess.dedup_text(hits).join(questions.select("query_id", "query_text"), "query_id")
        hits = written(providers.reranked(hits, self._service(self.rerank), SHOWN), "hits")  # a few a question; all below read them
        found = postprocess.conflicts(hits)
        windows = postprocess.sentence_windows(hits, stored["chunk"])
        return {"questions": asked.drop("vectors"), "hits": windows, "conflicts": found, "contexts": postprocess.contexts(windows, found), "sources": postprocess.source_labels(hits)}

    def prompts(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """query_id, expanded_query, context, messages: what the model gets for each question. With a history (conv_id,
        turn, role, text) and questions with conv_id, the last turns and a note on a follow-up go with it."""
        found = self.search(questions, history)
        rows = found["questions"].join(found["contexts"], "query_id", "left")
        if history is not None and "conv_id" in questions.columns:
            rows = rows.join(chat.message_lists(history), "conv_id", "left")
        else:
            rows = rows.withColumn("said", F.lit(None).cast("array<struct<role:string,content:string>>"))
        other = F.when(F.col("expanded") != F.col("query_text"), F.col("expanded"))
        follows = (F.size(F.coalesce("said", F.array())) > 0) & has_followup_signal("query_text")
        system = F.concat_ws(
            " ",
            F.lit("Answer from the documents below only and cite their sources."),
            F.when(follows, F.lit("The question follows up on what was said before: take that into account.")),
            F.concat(F.lit("The question was taken as: "), other),
            F.when(F.col("has_conflicts"), F.lit("The documents hold conflicting values: name them.")),
        )
        asked = F.concat("context", F.lit("\n\n"), "query_text")
        return rows.select("query_id", other.alias("expanded_query"), "context", chat.prompt(system, F.col("said"), asked).alias("messages"))

    def answer(self, questions: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """query_id, response, expanded_query. Without a model the response is the context that it would get; a question
        without a hit, and one for which the model says nothing, get a fixed text."""
        rows = self.prompts(questions, history)
        if self.complete is None:
            return rows.select("query_id", F.coalesce("context", F.lit(NO_HITS)).alias("response"), "expanded_query")
        asked = rows.withColumns({"messages": F.when(F.col("context").isNotNull(), F.col("messages")), "temperature": F.lit(0.2), "most": F.lit(2500)})
        asked = written(asked, "prompts", rows=1)  # a context is made once, not for the call and for its answer
        said = self._answers().answered(asked, "said")
        clean = clean_answer("said")
        response = F.when(F.col("context").isNull(), F.lit(NO_HITS)).when(F.coalesce(clean, F.lit("")) == "", F.lit(NO_ANSWER)).otherwise(clean)
        return said.select("query_id", response.alias("response"), "expanded_query")

    def verify(self) -> dict:
        return self.store.verify()

    def export(self, target: str) -> str:
        return self.store.export(target)

    def load(self, archive: str) -> dict:
        """Take in an exported store in place of this one, and say whether it is whole."""
        return Store.from_zip(self.spark, archive, self.path).verify()

    def progress(self) -> dict:
        return self.store.load_progress()

    def export_chat(self, history: DataFrame) -> DataFrame:
        return chat.exported(history)

    def clear_chat(self, history: DataFrame, conv_id: int) -> DataFrame:
        """A conversation's history without its messages; vectors stay."""
        return history.filter(F.col("conv_id") != conv_id)
