"""Small files that exist whole or not at all, and that only one writer can create: what manifests and logs are made of."""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder. Unfinished and hidden files aren't shown."""
    fs, p = place(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for s in fs.listStatus(p) if not (n := s.getPath().getName()).startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = place(spark, path)
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet; False where it is. The text is written beside it first, so a reader never sees
    a part, and of two writers at once one succeeds: on a local or mounted disk by a hard link, elsewhere by a rename,
    which HDFS and stores with atomic renames refuse where the name is taken."""
    folder, name = path.rsplit("/", 1)
    fs, parent = place(spark, folder)
    fs.mkdirs(parent)
    beside = f".{name}.{uuid.uuid4().hex}"
    where = fs.resolvePath(parent).toUri()
    if (where.getScheme() or "file") == "file":
        top = where.getPath()
        with open(f"{top}/{beside}", "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(f"{top}/{beside}", f"{top}/{name}")
        except FileExistsError:
            return False
        finally:
            os.unlink(f"{top}/{beside}")
        return True
    _, temporary = place(spark, f"{folder}/{beside}")
    _, final = place(spark, path)
    out = fs.create(temporary, True)
    out.write(text.encode())
    out.close()
    with contextlib.suppress(Exception):  # some stores raise where the name is taken, others say False
        if not fs.exists(final) and fs.rename(temporary, final):
            return True
    fs.delete(temporary, False)
    return False
