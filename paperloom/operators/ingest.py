"""Bookkeeping of an ingest: what was skipped, what is done, where to go on, whether the index is whole, who is idle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_PAGES = 10


def skip_report(status: DataFrame, shown: int = SHOWN_PAGES) -> DataFrame:
    """status: filename, page_num, reason. By kind of reason (what stands before a colon): n and the first pages. Only
    the least page numbers are gathered, not all of a reason."""
    kinds = status.filter("reason is not null").select(F.substring_index("reason", ":", 1).alias("kind"), "page_num")
    distinct = kinds.groupBy("kind", "page_num").agg(F.count("*").alias("times"))
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    first = distinct.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("page_num"))).filter(F.col("r") <= shown)
    pages = first.groupBy("kind").agg(F.array_sort(F.collect_list("page_num")).alias("p"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(" +"), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return counts.join(pages, "kind").select("kind", "n", F.concat(F.array_join(F.col("p").cast("array<string>"), ", "), more).alias("pages"))


def pending(chunks: DataFrame, done_files: DataFrame) -> DataFrame:
    """Chunks of files that aren't done."""
    return chunks.join(done_files.select("filename").distinct(), "filename", "left_anti")


def resume_decision(n_indexed: int, n_saved: int) -> tuple[str, int]:
    """What to do with an index of n_indexed vectors when n_saved were noted: resume from there, cut the index to what
    was noted and resume, or discard."""
    if n_indexed == n_saved:
        return "resume", n_saved
    if n_saved > 0 and n_indexed > n_saved:
        return "truncate", n_saved
    return "discard", 0


def truncated(index: DataFrame, n_saved: int) -> DataFrame:
    return index.filter(F.col("chunk_id") < n_saved)


def ingest_counts(chunks: DataFrame) -> DataFrame:
    """chunks with embedding: total, successful, skipped. A chunk without a vector counts as done, not as successful."""
    return chunks.agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNotNull()).alias("successful"), F.count_if(F.col("embedding").isNull()).alias("skipped"))


def index_health(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: total_vectors, total_documents, index_healthy."""
    v = vectors.agg(F.count("*").alias("total_vectors"))
    return v.withColumn("total_documents", documents.agg(F.count("*")).scalar()).withColumn("index_healthy", F.col("total_vectors") == F.col("total_documents"))


def idle_sessions(events: DataFrame, hours: int = 24, as_of: DataFrame | None = None) -> DataFrame:
    """events: user_id, ts. Users whose last event is more than so many hours before as_of (one row with ts; by default
    the last event of all): user_id, last_seen."""
    now = (events if as_of is None else as_of).agg(F.max("ts").alias("now"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    idle = last.withColumn("now", now.scalar())
    return idle.filter(F.col("now") - F.col("last_seen") > F.expr(f"interval {hours} hours")).select("user_id", "last_seen")
