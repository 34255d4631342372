"""Where uploaded files land: a folder a session, so that sessions don't write over each other's files of one name."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import allowed_file

LANDED = "session_id string, upload_id string, filename string, content binary, uploaded_at timestamp"


def safe_name(name: str | None) -> str:
    """A name without folders: letters that have an ASCII form take it, slashes and white space become underscores, what isn't
    a letter, digit, dot, dash or underscore goes, as do dots and underscores at the ends. It may be empty."""
    plain = unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode()
    parts = re.split(r"[\s/\\]+", plain)
    return re.sub(r"[^A-Za-z0-9_.-]", "", "_".join(p for p in parts if p)).strip("._")


@F.pandas_udf(T.StringType())
def _safe_names(names: pd.Series) -> pd.Series:
    return names.map(safe_name)


def land(files: DataFrame, target: str) -> None:
    """files: session_id, filename, content. Those of an allowed kind are added under target/session=<id>, with the name that they
    are stored by; others, and those whose name has nothing left, aren't. Contents are written where they are, not moved."""
    named = files.withColumn("filename", _safe_names("filename")).filter(allowed_file("filename") & (F.col("filename") != ""))
    rows = named.select(F.col("session_id").cast("string").alias("session_id"), F.uuid().alias("upload_id"), "filename", "content", F.current_timestamp().alias("uploaded_at"))
    rows.withColumn("session", F.col("session_id")).write.mode("append").partitionBy("session").parquet(target)


def landed(spark: SparkSession, target: str, session: str | None = None) -> DataFrame:
    """session_id, filename, content, uploaded_at: of files of one name in a session the last one (of two at one time, either).
    With a session, only its folder is read. Which uploads count is told without their contents."""
    rows = spark.read.schema(f"{LANDED}, session string").parquet(target)
    if session is not None:
        rows = rows.filter(F.col("session") == session)
    last = rows.groupBy("session_id", "filename").agg(F.max_by("upload_id", F.struct("uploaded_at", "upload_id")).alias("upload_id"))
    return rows.join(last.select("upload_id"), "upload_id", "left_semi").select("session_id", "filename", "content", "uploaded_at")
