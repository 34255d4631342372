"""The corpus pipeline: language, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
reads it again as the next one's docs. All stages but the last return the columns of documents. Stages leave the tables
that their results read, and delete none of other calls. run() deletes those of its own stages whose results it has written;
what its result reads stays, so earlier and later runs, and runs at once, don't touch each other's tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import langid, neardup, packing, quality, substrings
from paperloom.llm.common import discard, prepare, written
from paperloom.llm.queries import IDS, PATTERN
from paperloom.shared import delete, gathered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose likeliest language is less likely than this, among those learned, isn't taken as text of any. The
#: likeliest of k is at least 1/k, so with few languages only langid.familiar() rejects text of others.
LEAST_LANGUAGE_SCORE = 0.3


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null or without letters, or in none that is learned. The latter are told
    by their trigrams, with a threshold from held-out rows; where no row is held out, none is rejected for them.

    A null doc_id or lang isn't learned from but judged like others; repeated rows are judged each; a very long text is
    judged whole; where no text has a language, as in an empty table, nothing is left."""
    docs = _documents(docs)
    named = langid.annotated(docs, *langid.fitted_with_familiar(docs))
    return named.filter((F.col("lang_pred") != langid.NONE) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is below the threshold. Labels join the statistics by doc_id; texts stay
    where they are.

    A null text is scored as an empty one; a null doc_id has no label; repeated rows are scored each, and each counts in
    training; a very long text is measured whole; without labels of both kinds all texts have the labels' mean as their
    score, or 0.5, so that all stay unless the labels are mostly 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.annotated(_documents(docs), labels).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the least doc_id (a null comes last).

    Rows, not doc_ids, are compared: those with a null doc_id, or with one that other texts have too, stay or go by
    their own text. Rows that repeat both doc_id and text are one, also where the text has no words. Null and empty texts
    are like no other; very long texts are compared whole; an empty table stays empty."""
    prepare(spark)
    # written, so that a row's key is the same wherever it is read; texts aren't shuffled for it
    rows = written(_documents(docs).withColumn("row", F.monotonically_increasing_id()), "rows")
    with gathered() as made:
        groups = neardup.grouped(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
        ids = groups.join(rows.select("row", "doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest")), "row")
        wordless = F.col("n_shingles") == 0  # these link with nothing
        group = [F.when(~wordless, F.col("component_id")).alias("c"), F.when(wordless, F.col("doc_id")).alias("i"), F.when(wordless, F.col("digest")).alias("d")]
        keep = ids.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "row")).alias("least")).select("least.row")
        drop = written(rows.select("row").join(keep, "row", "left_anti"), "dropped")
    for path in made:  # the groups are told, so what told them goes
        if path != drop.written_path:
            delete(spark, path)
    return rows.join(drop, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 200 bytes that occur more than once out of the texts; documents stay, n_chars follows.

    A null text stays null, one that is all repeated becomes empty; repeated rows repeat each other's strings, whatever
    their doc_ids; very long texts are worked off in parts; an empty table stays empty."""
    return substrings.stripped(_documents(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences.

    A null or empty text is its end id alone; null doc_ids stay null; repeated rows are packed each; a very long text
    is cut into pieces; an empty table gives no rows."""
    return packing.packed(_documents(docs), IDS, PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: Trained models and the order in which best fit places pieces can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        with gathered() as made:
            before, docs = docs, written(f(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        for path in made:
            if path != docs.written_path:
                delete(spark, path)
        discard(before)  # the input's table isn't one of ours, so it stays
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
