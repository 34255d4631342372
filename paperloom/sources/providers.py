"""Outside services as plug-ins: embedders, language models, rerankers. Each is a plain callable; the defaults need no
network and are what the engine does when a service fails."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import lines, strip
from paperloom.shared import bounded_batches, new_path, written
from paperloom.sources.commits import names

#: Vectors in the order of the texts, or answers that say the place of each: {"index": i, "embedding": [...]}.
Embed = Callable[[list[str]], list]
Complete = Callable[[list[dict], float, int], str]
Rerank = Callable[[list[tuple[str, str]]], list[float]]


def retried(call: Callable, tries: int = 3, delay: float = 1.0, factor: float = 2.0, errors: tuple = (Exception,)) -> Callable:
    """Call again after growing pauses; the last error is raised."""

    def run(*args, **kw):
        pause = delay
        for left in reversed(range(tries)):
            try:
                return call(*args, **kw)
            except errors:
                if not left:
                    raise
                time.sleep(pause)
                pause *= factor

    return run


def rate_limited(call: Callable, per_second: float) -> Callable:
    """At most so many calls a second in this process. With k tasks at once, give each its share."""
    lock, last = threading.Lock(), [0.0]

    def run(*args, **kw):
        with lock:
            wait = last[0] + 1 / per_second - time.monotonic()
            if wait > 0:
                time.sleep(wait)
            last[0] = time.monotonic()
        return call(*args, **kw)

    return run


#: The last slot that this worker took, by the service's start and the lane.
_TAKEN: dict[tuple[float, int], int] = {}


def next_slot(start: float, per_second: float, lanes: int, lane: int, now: float) -> int:
    """Slot k stands k / per_second after the start, and belongs to lane k % lanes. The lane's first slot that isn't over and
    that this worker didn't take."""
    k = max(0, math.ceil((now - start) * per_second))
    k += (lane - k) % lanes
    return max(k, _TAKEN.get((start, lane), lane - lanes) + lanes)


class Service:
    """A provider's callable with retries and a limit of calls a second over all tasks. share is the number of lanes, and
    so of tasks that may call at once: a task calls in the slots of its own lane (its number among the tasks), counted from
    a start that all of them know, so calls of all tasks together never come faster than the limit; each try takes a slot.
    Whoever plans the tasks gives them share partitions (see in_lanes)."""

    def __init__(self, call: Callable, tries: int = 3, delay: float = 1.0, per_second: float | None = None, share: int = 1, start: float | None = None):
        self.start = time.time() if start is None else start
        self.args, self.per_second, self.share, self.run = (call, tries, delay, per_second, share, self.start), per_second, share, None

    def in_slot(self, call: Callable) -> Callable:
        lane = TaskContext.get().partitionId() % self.share if TaskContext.get() else 0

        def run(*args):
            now = time.time()
            slot = next_slot(self.start, self.per_second, self.share, lane, now)
            _TAKEN[self.start, lane] = slot
            time.sleep(max(0.0, self.start + slot / self.per_second - now))
            return call(*args)

        return run

    def __call__(self, *args):
        if self.run is None:
            call, tries, delay = self.args[:3]
            self.run = retried(self.in_slot(call) if self.per_second else call, tries, delay)
        return self.run(*args)

    def __reduce__(self):
        return Service, self.args


def lanes_for(tasks: int, per_second: float | None, seconds: float = 2.0) -> int:
    """Lanes of a service: as many as calls are under way at once if each takes so many seconds, at most one a task that
    can run. More would leave slots of lanes unused that have nothing to do."""
    return max(1, min(tasks, math.ceil(per_second * seconds))) if per_second else tasks


def in_lanes(rows: DataFrame, call: Callable) -> DataFrame:
    """Rows dealt to exactly as many partitions as a limited service has lanes; adaptive execution keeps that number."""
    return rows.repartition(call.share) if isinstance(call, Service) and call.per_second else rows


#: What a worker made for a Held, by its key.
_MADE: dict = {}


class Held:
    """A provider that has to be made before it can be called, such as a model that is loaded: make() gives the callable, once
    a worker, however many tasks and batches that serves. Workers make it for themselves; key tells providers apart."""

    def __init__(self, make: Callable[[], Callable], key: str):
        self.make, self.key = make, key

    def __call__(self, *args):
        if self.key not in _MADE:
            _MADE[self.key] = self.make()
        return _MADE[self.key](*args)


def placed(answer: list, n: int) -> list:
    """The vectors of n texts: answers with an index go to that place, others to their own; null where none came."""
    out: list = [None] * n
    for k, item in enumerate(answer):
        at, vector = (item.get("index", k), item.get("embedding")) if isinstance(item, dict) else (k, item)
        if 0 <= at < n:
            out[at] = vector
    return out


def embedded(texts: DataFrame, embed: Embed, batch: int = 16, partitions: int | None = None) -> DataFrame:
    """texts: text (distinct), with embedding; null where the service fails. A batch that fails fails alone."""
    source = in_lanes(texts, embed) if partitions is None else texts.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list = []
            for lo in range(0, len(b), batch):
                some = b["text"].iloc[lo : lo + batch].tolist()
                try:
                    got = placed(embed(some), len(some))
                except Exception:
                    got = [None] * len(some)
                out += got
            yield pd.DataFrame({"text": b["text"].to_numpy(), "embedding": out})

    return source.select("text").mapInPandas(run, "text string, embedding array<float>")


def embedded_batches(batches: DataFrame, embed: Embed, name: str = "vectors") -> DataFrame:
    """batches: texts (array<string>) and any other columns; a batch is one row and one call. With an array of as many vectors,
    text by text at the same place: null for a null text (which isn't sent), for a place that the answer leaves out,
    and for all of a batch whose call fails. Nothing is joined: what a vector belongs to stands in the same row."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            out = []
            for texts in b["texts"]:
                wanted = [i for i, t in enumerate(texts) if t is not None]
                vectors: list = [None] * len(texts)
                try:
                    got = placed(embed([texts[i] for i in wanted]), len(wanted)) if wanted else []
                except Exception:
                    got = [None] * len(wanted)
                for i, v in zip(wanted, got):
                    vectors[i] = v
                out.append(vectors)
            yield b.assign(**{name: out})

    schema = T.StructType([*batches.schema.fields, T.StructField(name, T.ArrayType(T.ArrayType(T.FloatType())))])
    bounded_batches(batches.sparkSession)  # a row holds a batch's texts
    return in_lanes(batches, embed).mapInPandas(run, schema)


def message(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def prompt_key(messages: str = "messages", temperature: str = "temperature", most: str = "most") -> Column:
    """Names a call: the same messages and parameters have the same key."""
    return F.sha2(F.to_json(F.struct(messages, temperature, most)), 256)


class Answers:
    """A model's answers by prompt_key, as a table under path: each call is made once, and its answer is written before anything
    reads it. Calls that failed have a null answer, and are made again when they are asked for the next time. Without a path
    the answers are kept for this object's calls only."""

    def __init__(self, spark, complete: Complete, path: str | None = None):
        self.spark, self.complete, self.path = spark, complete, path or new_path(spark, "answers")

    def known(self) -> DataFrame:
        """The answers so far. Each lot of calls has a folder of its own, and all are named here: Spark takes two readings of
        one folder in a plan for the same, even where files came between."""
        lots = [n for n in names(self.spark, self.path) if n.startswith("asked-")]
        if not lots:
            return self.spark.createDataFrame([], "key string, answer string")
        return self.spark.read.schema("key string, answer string").parquet(*[f"{self.path}/{n}" for n in lots])

    def ask(self, prompts: DataFrame) -> DataFrame:
        """prompts: messages, temperature, most. key, answer of each different one; only those without an answer are called for.
        Where two writers had the same question at once, both get the lesser answer."""
        complete = self.complete
        wanted = prompts.select(prompt_key().alias("key"), "messages", "temperature", "most").dropDuplicates(["key"])
        new = wanted.join(self.known().filter("answer is not null"), "key", "left_anti")

        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in rows:
                answers = []
                for messages, temperature, most in zip(b["messages"], b["temperature"], b["most"]):
                    try:
                        answers.append(complete([{"role": m["role"], "content": m["content"]} for m in messages], float(temperature), int(most)))
                    except Exception:
                        answers.append(None)
                yield pd.DataFrame({"key": b["key"].to_numpy(), "answer": answers})

        in_lanes(new, complete).mapInPandas(run, "key string, answer string").write.parquet(f"{self.path}/asked-{uuid.uuid4().hex}")
        return self.known().join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("answer").alias("answer"))

    def answered(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with messages, temperature and most (null messages: nothing is asked), and the answer's text in place of them."""
        keyed = rows.withColumn("key", F.when(F.col("messages").isNotNull(), prompt_key()))
        got = self.ask(rows.filter("messages is not null")).withColumnRenamed("answer", name)
        return keyed.join(got, "key", "left").drop("key", "messages", "temperature", "most")


def expanded(queries: DataFrame, complete: Complete | None = None, answers: Answers | None = None) -> DataFrame:
    """queries (query_id, query_text, complexity, summary) with expanded, hyde and variants. Without a model, or where
    its answer is too short: the query itself, nothing, none. Simple questions get no passage and no variants. Each
    different prompt is one call, however often the result is read: the answers are written, and so is the result."""
    if complete is None:
        return queries.withColumns({"expanded": F.col("query_text"), "hyde": F.lit(""), "variants": F.array().cast("array<string>")})
    answers = answers or Answers(queries.sparkSession, complete)

    def asking(rows: DataFrame, ask: Column, temperature: float, most: int, name: str) -> DataFrame:
        return answers.answered(rows.withColumns({"messages": ask, "temperature": F.lit(temperature), "most": F.lit(most)}), name)

    rewrite = F.concat(F.coalesce("summary", F.lit("")), F.lit("\nRewrite this question so that it can be searched for on its own: "), F.col("query_text"))
    rows = asking(queries, message("user", rewrite), 0.1, 250, "rewritten")
    better = strip(F.coalesce("rewritten", F.lit("")))
    rows = rows.withColumn("expanded", F.when(F.length(better) > 10, better).otherwise(F.col("query_text"))).drop("rewritten")
    complex_ = F.col("complexity") == "complex"
    rows = asking(rows, F.when(complex_, message("user", F.concat(F.lit("Write a short passage that would answer: "), "expanded"))), 0.1, 200, "passage")
    rows = asking(rows, F.when(complex_, message("user", F.concat(F.lit("Give two other wordings, one a line, of: "), "expanded"))), 0.3, 200, "wordings")
    passage = strip(F.coalesce("passage", F.lit("")))
    other = F.filter(F.transform(lines(F.coalesce("wordings", F.lit(""))), lambda x: strip(x)), lambda x: F.length(x) > 10)
    rows = rows.withColumns({"hyde": F.when(F.length(passage) > 20, passage).otherwise(F.lit("")), "variants": F.slice(other, 1, 2)})
    return written(rows.select(*queries.columns, "expanded", "hyde", "variants"), "wordings", rows=1)


def reranked(hits: DataFrame, rerank: Rerank | None = None, n: int = 10) -> DataFrame:
    """The n best hits of each query by a reranker's score of (query_text, text); without one, the first n."""
    from pyspark.sql.window import Window

    if rerank is None:
        scored = hits.withColumn("rerank_score", F.lit(None).cast("double"))
        order = Window.partitionBy("query_id").orderBy("rank0")
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(rerank_score=[float(x) for x in rerank(list(zip(b["query_text"], b["text"])))] if len(b) else pd.Series([], dtype=float))

        scored = in_lanes(hits, rerank).mapInPandas(run, T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType())]))
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank0")
    return scored.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n).withColumn("rank0", F.col("place")).drop("place")
