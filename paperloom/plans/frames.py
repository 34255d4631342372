"""The inputs of the queries, as the tables give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import chunking


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than there are cores, so a small one, dealt over all of them; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents, numbered."""
    return chunking.numbered_text_chunks(chunking.pages_from_documents(spread(table(spark, sf_dir, "documents"))))


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk whose number is its id."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("filename"), F.col("doc_id").alias("page_num"), F.concat("source", F.lit(" - Page "), F.col("doc_id").cast("string")).alias("source"), F.lit("text").alias("chunk_type"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item with the vector of its number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return b.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of six parts as tables with a header, of which some labels and cells are blank, and a page's text with
    captions on some pages and notes on others: filename, page_num, table_idx, cells, page_text."""
    p = table(spark, sf_dir, "part").withColumn("block", F.floor(F.col("p_partkey") / 6).cast("int"))
    key = F.col("p_partkey")
    row = F.array(
        key.cast("string"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.col("p_name")),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" "), "p_brand", F.lit("\nx"))),
        F.when(key % 3 == 0, F.lit(" ")).otherwise(F.col("p_size").cast("string")),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.when(key % 4 == 0, F.array(F.lit(""), F.lit(None).cast("string"), F.lit(" "), F.lit(""))).otherwise(row).alias("r")))), lambda x: x["r"])
    blocks = p.groupBy("block").agg(rows.alias("rows"), F.min("p_type").alias("kind"))
    b = F.col("block")
    header = (
        F.when(b % 4 == 0, F.array(F.lit("Key"), F.lit("Name"), F.lit("Brand"), F.lit("Size")))
        .when(b % 4 == 1, F.array(F.lit("Key"), F.lit(""), F.lit(None).cast("string"), F.lit("Size")))
        .when(b % 4 == 2, F.array(F.lit("Key"), F.lit(" "), F.lit("Brand"), F.lit("Key")))
        .otherwise(F.array(F.lit(""), F.lit("Name"), F.lit(""), F.lit("")))
    )
    text = F.concat_ws(
        "\n",
        F.lit("Some prose about parts."),
        F.when(b % 3 == 0, F.concat(F.lit("  Table "), b.cast("string"), F.lit(" "), F.col("kind"))),
        F.when(b % 6 == 0, F.concat(F.lit("Figure "), b.cast("string"), F.lit(" Second caption"))),
        F.when(b % 2 == 0, F.lit("NOTES: first note")),
        F.when(b % 2 == 0, F.concat(F.lit("second note of "), "kind")),
        F.lit("END OF NOTES"),
        F.lit("More prose."),
    )
    return blocks.select(F.concat(F.lit("file"), (b % 5).cast("string")).alias("filename"), b.alias("page_num"), (b % 2).alias("table_idx"), F.concat(F.array(header), F.col("rows")).alias("cells"), text.alias("page_text"))


def pipe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table as pipe-delimited lines between prose, and a one-line block that is no table."""
    p = table(spark, sf_dir, "part").withColumn("block", F.floor(F.col("p_partkey") / 6).cast("int"))
    line = F.concat_ws(" | ", F.concat(F.lit("| "), F.col("p_partkey").cast("string")), "p_name", F.concat("p_brand", F.lit(" |")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("l")))), lambda x: x["l"]), "\n")
    blocks = p.groupBy("block").agg(rows.alias("rows"))
    text = F.concat_ws("\n", F.lit("Prose before."), F.lit("| Key | Name | Brand |"), F.lit("|---|:-: | --- |"), "rows", F.lit("Prose after."), F.lit("| alone | here |"), F.lit("The end."))
    return blocks.select("block", text.alias("text"))
