"""Results that are written to the folder which all executors share, and read again."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that a small result isn't spread beyond; bytes of a row group, which writers hold in memory.
TASK_ROWS, ROW_GROUP = 8_000, 16 << 20
#: Rows and bytes of an Arrow batch: a Python worker holds one batch, so these bound its memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Where the paths of written tables are gathered, if a caller in this thread does.
_GATHERED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("gathered", default=None)


@contextlib.contextmanager
def gathered() -> Iterator[list[str]]:
    """The paths of the tables that this thread writes meanwhile, so that whoever knows when nothing reads them any more can
    delete them. Tables of other threads, and of other callers, aren't among them; an outer gathering gets them too."""
    outer, mine = _GATHERED.get(), []
    token = _GATHERED.set(mine)
    try:
        yield mine
    finally:
        _GATHERED.reset(token)
        if outer is not None:
            outer.extend(mine)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none and all runs on this machine (tests), a folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def bounded_batches(spark: SparkSession) -> None:
    """Python workers of this session get batches of bounded size, however large a row is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that a result of so many rows is worth, whatever the number of shuffle partitions is; one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def written(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None, dealt: bool = False, path: str | None = None) -> DataFrame:
    """Cuts lineage, survives lost executors, and computes df once. rows: about how many there are, where that is
    known; then there are no more files than those are worth, also where adaptive execution may not merge shuffle
    partitions. Partitions are merged for that; with dealt, rows are dealt out to the files instead, so that work which
    is split by skew stays split: for results that are small beside what they come from. path: where it goes to stay, in place of
    what is there; by default a new folder among the shared ones."""
    spark = df.sparkSession
    made, path = None if path else _GATHERED.get(), path or new_path(spark, name)
    if rows is not None:
        files = tasks_for(spark, rows)
        df = df.repartition(files) if dealt else df.coalesce(files)
    if made is not None:
        made.append(path)
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more. One that can't be deleted stays."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if path:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
