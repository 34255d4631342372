"""Helpers that every operator of this subpackage uses: shared storage, session set-up, word caches."""

from __future__ import annotations

import contextlib
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.shared import BATCH_BYTES, BATCH_ROWS, bounded_batches, discard, new_path, shared_dir, written

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "discard", "filesystem", "held", "new_path", "prepare", "publish", "release", "segments", "shared_dir", "spare", "strings", "undotted", "utf8", "without", "written"]

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable on the workers and bound the Arrow batches that they get."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        env[key] = "1"
    env["TOKENIZERS_PARALLELISM"] = "false"
    bounded_batches(spark)
    # shuffle files of a finished step go at once: its result is in the shared folder
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


_HELD: dict = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """A worker's model or tokenizer, made once. A worker holds one at a time: where stages follow one another in the
    same worker, the one of the stage before goes, and its memory goes back to the system."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """For the begin of tasks without a model: drop the one of a stage before, and give back to the system what this
    worker's tasks freed, where the C library can."""
    import ctypes

    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, changed until no column of df is called so (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that are called so (case doesn't count): those that an operator adds take their place."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def undotted(df: DataFrame) -> DataFrame:
    """df, its names without dots, which mapInArrow can't read; their order stays, so that toDF gives them back."""
    if not any("." in c for c in df.columns):
        return df
    return df.toDF(*spare(df.select(), *[c.replace(".", "_") for c in df.columns]))


def filesystem(uri: str):
    """A pyarrow file system and the path within it, for file:, hdfs:, s3: and the like."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(fs, temporary: str, final: str) -> None:
    """Give a whole file its name. A task that runs twice writes the same file, so one that is there already stays."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).is_file:
            fs.delete_file(temporary)
        else:
            raise


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of a column; a null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> tuple:
    """A column's bytes as one uint8 array and int64 offsets; a null counts as empty. No copy of single texts."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def segments(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Cut a long text where white space follows something else: no match of the word pattern spans such a place,
    and what follows it is matched as it would be in the whole text."""
    import re

    at, find = 0, re.compile(r"(?<=\S)\s")
    while len(text) - at > size:
        m = find.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text
