"""What happens to a query's hits: near-duplicates, conflicting values, neighbour windows, context, sources.

A query has a bounded number of hits (15 or 20), so they are folded as one array a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import first_sentences, is_section_boundary, words
from paperloom.functions.vectors import cosine
from paperloom.operators.lexical import sent
from paperloom.shared import written

VALUE = r"(?iu)\d+(?:\.\d+)?\s*(?:°C|°F|mm|MPa|psi|bar|inches?|hours?|days?)"
VALUE_PARTS = r"(?iu)^(\d+(?:\.\d+)?)\s*(.*)$"


def _folded(hits: DataFrame, same) -> DataFrame:
    """Keep a hit unless it is the same as one that was kept before it. hits: query_id, rank0 and others."""
    rest = [c for c in hits.columns if c != "query_id"]
    row = F.struct("rank0", *[c for c in rest if c != "rank0"])
    grouped = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("hits"))
    empty = F.filter("hits", lambda h: F.lit(False))
    kept = F.aggregate("hits", empty, lambda acc, h: F.when(F.exists(acc, lambda k: same(k, h)), acc).otherwise(F.concat(acc, F.array(h))))
    return grouped.select("query_id", F.explode(kept).alias("h")).select("query_id", *[F.col(f"h.{c}").alias(c) for c in rest])


def dedup_text(hits: DataFrame, chars: int = 100, share: float = 0.7) -> DataFrame:
    """Same source, and of the first characters' words more than a share of the shorter list in common."""

    def tokens(h: Column) -> Column:
        return words(F.lower(F.substring(h["text"], 1, chars)))

    def same(k: Column, h: Column) -> Column:
        a, b = tokens(k), tokens(h)
        return (k["source"] == h["source"]) & (F.size(F.array_intersect(a, b)) > share * F.least(F.size(a), F.size(b)))

    return _folded(hits, same)


def dedup_semantic(hits: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Cosine above the threshold; a hit without a vector is the same as none."""
    return _folded(hits, lambda k, h: F.coalesce(cosine(k["embedding"], h["embedding"]) > threshold, F.lit(False)))


def conflicts(hits: DataFrame) -> DataFrame:
    """hits: query_id, rank0, source, text. One row a parameter and unit with several values: query_id, conflict_key,
    n_values, first_rank, message. The parameter is named by the last capitalised words in the 50 characters before a
    value, so a name that was mentioned just before joins in; units aren't converted."""
    found = F.regexp_extract_all("text", F.lit(VALUE), F.lit(0))
    between = F.split("text", VALUE, -1)
    zero = F.struct(F.lit("").alias("before"), F.array().cast("array<struct<i:int,context:string,value:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        before = F.concat(acc["before"], F.get("between", i))
        item = F.struct(i.alias("i"), F.substring(before, -50, 50).alias("context"), F.get("found", i).alias("value"))
        return F.struct(F.concat(before, F.get("found", i)).alias("before"), F.concat(acc["out"], F.array(item)).alias("out"))

    rows = hits.select("query_id", "rank0", "source", found.alias("found"), between.alias("between")).filter(F.size("found") > 0)
    rows = rows.select("query_id", "rank0", "source", F.explode(F.aggregate(F.sequence(F.lit(0), F.size("found") - 1), zero, step, lambda acc: acc["out"])).alias("v"))
    names = F.regexp_extract_all("v.context", F.lit(r"\b[A-Z][a-z]+\b"), F.lit(0))
    last = F.slice(names, F.greatest(F.size(names) - 2, F.lit(1)), 3)
    param = F.when(F.size(names) > 0, F.array_join(last, " ")).otherwise(F.lit("value"))
    unit = F.lower(F.regexp_extract("v.value", VALUE_PARTS, 2))
    rows = rows.select("query_id", "rank0", F.col("v.i").alias("i"), F.regexp_extract("v.value", VALUE_PARTS, 1).cast("double").alias("value"), unit.alias("unit"), "source", F.concat(param, F.lit("_"), unit).alias("conflict_key"))
    grouped = rows.groupBy("query_id", "conflict_key").agg(F.array_sort(F.collect_list(F.struct("rank0", "i", "value", "unit", "source"))).alias("all"))
    grouped = grouped.filter(F.size(F.array_distinct(F.transform("all", lambda x: x["value"]))) > 1)
    shown = F.array_join(F.transform("all", lambda x: F.concat(x["value"].cast("string"), F.lit(" "), x["unit"], F.lit(" ("), x["source"], F.lit(")"))), ", ")
    message = F.concat(F.lit("CONFLICT in "), F.replace("conflict_key", F.lit("_"), F.lit(" ")), F.lit(": "), shown)
    return grouped.select("query_id", "conflict_key", F.size("all").alias("n_values"), F.get("all", F.lit(0))["rank0"].alias("first_rank"), message.alias("message"))


def sentence_windows(hits: DataFrame, chunks: DataFrame, window: int = 1, most: int = 2000) -> DataFrame:
    """hits (query_id, rank0, source, chunk_type, text, ...) with window_text: for text hits the neighbours of the same
    source join in, up to a section boundary or another type. chunks: chunk_id, source, chunk_type, text. Only chunks
    of the hits' sources are put in order, each source by itself; no others are shuffled."""
    sources = written(hits.select("source").distinct(), "sources", rows=1)
    mine = chunks.filter("chunk_type <> 'table-full'").join(sent(sources), "source", "left_semi")
    order = Window.partitionBy("source").orderBy("chunk_id")
    peers = mine.withColumn("peers", F.count("*").over(Window.partitionBy("source")))
    parts, ok = [F.col("text")], None
    cols: list[Column] = []
    for direction, take in (("b", F.lag), ("f", F.lead)):
        for k in range(1, window + 1):
            cols.append(take(F.struct("text", "chunk_type"), k).over(order).alias(f"{direction}{k}"))
    peers = peers.select("chunk_id", "source", "chunk_type", "text", "peers", *cols)
    before: list[Column] = []
    after: list[Column] = []
    for direction, into in (("b", before), ("f", after)):
        ok = F.lit(True)
        for k in range(1, window + 1):
            c = F.col(f"{direction}{k}")
            ok = ok & c.isNotNull() & ~F.coalesce(is_section_boundary(c["text"]), F.lit(False)) & (c["chunk_type"] == F.col("chunk_type"))
            into.append(F.when(ok, c["text"]))
    joined = F.concat_ws(" ", *reversed(before), *parts, *after)
    ready = peers.select("chunk_id", "source", "text", F.when(F.col("peers") > 1, first_sentences(joined, most)).otherwise(F.col("text")).alias("window_text"))
    first = ready.groupBy("source", "text").agg(F.min_by("window_text", "chunk_id").alias("window_text"))
    out = hits.join(first, ["source", "text"], "left")
    return out.withColumn("window_text", F.when((F.col("chunk_type") == "text") & F.col("window_text").isNotNull(), F.col("window_text")).otherwise(F.col("text"))).select(*hits.columns, "window_text")


def contexts(windows: DataFrame, conflicts_: DataFrame) -> DataFrame:
    """One text a query for the model: a header, conflicts if there are any, sources and contents in order."""
    part = F.concat(F.lit("\nSource: "), "source", F.lit("\nContent: "), "window_text", F.lit("\n"))
    body = windows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank0", part.alias("p")))).alias("parts"))
    warn = conflicts_.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first_rank", "conflict_key", "message"))).alias("c"))
    warn = warn.select("query_id", F.concat(F.lit("\nDETECTED CONFLICTS:\n"), F.array_join(F.transform("c", lambda x: x["message"]), "\n"), F.lit("\n")).alias("warning"))
    head = F.lit("RELEVANT DOCUMENTS:\n" + "=" * 50)
    return body.join(warn, "query_id", "left").select("query_id", F.concat_ws("\n", head, "warning", F.array_join(F.transform("parts", lambda x: x["p"]), "\n")).alias("context"), F.col("warning").isNotNull().alias("has_conflicts"))


def source_labels(hits: DataFrame) -> DataFrame:
    """hits: query_id, filename, page. The distinct labels of each query."""
    return hits.select("query_id", F.concat("filename", F.lit(" — Page "), F.col("page").cast("string")).alias("source_label")).distinct()
