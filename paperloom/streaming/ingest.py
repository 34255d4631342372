"""Resumable ingest as a file stream: pages in, chunks appended. A batch that is replayed adds nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.chunking import text_chunks
from paperloom.sources.commits import names


def ingest_stream(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    pages: Callable[[DataFrame], DataFrame] | None = None,
    schema: str = "filename string, page_num long, text string",
    once: bool = True,
) -> StreamingQuery:
    """Reads Parquet files of pages (or of what the function pages makes pages of) as they arrive and writes chunks,
    with embed's columns, to target/stream=<id>/batch=<number>: a batch that is replayed writes its own folder over, and reads
    nothing of what is there. The stream's checkpoint says what is done. Where other streams wrote to the target before, as
    after a lost checkpoint, what they have is told by (filename, page_num, chunk_seq)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = text_chunks(pages(batch) if pages else batch)
        session = batch.sparkSession
        own = f"stream={session.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        others = [n for n in names(session, target) if n.startswith("stream=") and n != own]
        if others:
            # only what is there of the batch's files can be there twice
            there = session.read.option("recursiveFileLookup", "true").parquet(*[f"{target}/{n}" for n in others]).select("filename", "page_num", "chunk_seq")
            there = there.join(chunks.select("filename").distinct(), "filename", "left_semi")
            chunks = chunks.join(there, ["filename", "page_num", "chunk_seq"], "left_anti")
        (embed(chunks) if embed else chunks).write.mode("overwrite").parquet(f"{target}/{own}/batch={batch_id}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
