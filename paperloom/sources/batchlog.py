"""The log of an ingest: what is staged, and which batches of it are done. Each entry is a file that one writer creates."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.commits import create_if_absent, names, read_text

ENTRY = "batch long, first_chunk long, last_chunk long, n_chunks long, n_vectors long, n_skipped long, n_files_ended long, current_file string, chunks_in_current long, written double"


class BatchLog:
    """Under path/ingest/<folder>: plan.json (chunks, size of a batch, dim) and batch-<number>.json, each written once what it
    tells of stands whole in its own folder of the store. An ingest that broke off goes on with the batches without an
    entry; what one of them had begun to write is written over."""

    def __init__(self, spark: SparkSession, path: str, folder: str):
        self.spark, self.store, self.folder, self.path = spark, path.rstrip("/"), folder, f"{path.rstrip('/')}/ingest/{folder}"

    @staticmethod
    def folders(spark: SparkSession, path: str) -> list[str]:
        """Ingests that were staged, the oldest first."""
        top = f"{path.rstrip('/')}/ingest"
        return [n for n in names(spark, top) if "plan.json" in names(spark, f"{top}/{n}")]

    def begin(self, n_chunks: int, size: int, dim: int) -> dict:
        row = {"folder": self.folder, "n_chunks": n_chunks, "size": size, "dim": dim, "written": time.time()}
        create_if_absent(self.spark, f"{self.path}/plan.json", json.dumps(row))
        return self.plan()

    def plan(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/plan.json"))

    def done(self) -> set[int]:
        return {int(n[6:-5]) for n in names(self.spark, self.path) if n.startswith("batch-")}

    def pending(self) -> list[int]:
        plan = self.plan()
        return sorted(set(range(-(-plan["n_chunks"] // plan["size"]))) - self.done())

    def commit(self, entry: dict) -> bool:
        return create_if_absent(self.spark, f"{self.path}/batch-{entry['batch']:09d}.json", json.dumps(entry | {"written": time.time()}))

    def rows(self) -> DataFrame:
        """A row a batch that is done (ENTRY)."""
        if not self.done():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("pathGlobFilter", "batch-*.json").json(self.path)

    def progress(self) -> dict:
        """What is done up to the first batch that isn't: batches, chunks, vectors, the file it stands in and how many of that
        file's chunks are done."""
        first = min(self.pending(), default=None)
        rows = self.rows() if first is None else self.rows().filter(F.col("batch") < first)
        last = F.max_by(F.struct("current_file", "chunks_in_current"), "batch")
        n, chunks, vectors, ended, at = rows.agg(F.count("*"), F.sum("n_chunks"), F.sum("n_vectors"), F.sum("n_files_ended"), last).first()
        return {"batches": n, "completed_chunks": chunks or 0, "total_vectors": vectors or 0, "completed_files": ended or 0, "current_file": at and at[0], "completed_chunks_in_file": (at and at[1]) or 0}

    def completed_files(self, chunks: DataFrame) -> DataFrame:
        """filename of the files all of whose chunks (filename, chunk_id as staged) are done: a table, as they may be many."""
        done = self.progress()["completed_chunks"]
        return chunks.groupBy("filename").agg(F.max("chunk_id").alias("last")).filter(F.col("last") < done).select("filename")
