"""Pages and tables of files: a binary scan and a pluggable extractor in Python workers.

An extractor is `extract(path, content) -> iterable of dict(page_num, candidates, tables, status)`: candidates are texts
from the best way of reading a page to the last resort, tables are lists of rows. None is built in, as PDF libraries
are optional; `plain_text` reads UTF-8 files with form feeds between pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import allowed_file, strip
from paperloom.operators.tables import markdown_tables
from paperloom.shared import written

PAGE = "filename string, page_num int, text string, status string, tables array<array<array<string>>>"
Extractor = Callable[[str, bytes], Iterable[dict]]


def plain_text(path: str, content: bytes) -> Iterator[dict]:
    for i, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield {"page_num": i, "candidates": [text], "tables": []}


def pdf_pages(path: str, content: bytes) -> Iterator[dict]:
    """With pdfplumber, where it is installed: plain text, looser text, words; ruled tables before unruled ones."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            try:
                tables = next((t for s in ("lines", "lines_strict", "text") if (t := page.extract_tables({"vertical_strategy": s, "horizontal_strategy": s}))), [])
                spoken = " ".join(w["text"] for w in page.extract_words(x_tolerance=5))
                yield {"page_num": i, "candidates": [page.extract_text(), page.extract_text(x_tolerance=3), spoken], "tables": tables}
            except Exception as e:  # one page's error leaves the others
                yield {"page_num": i, "candidates": [], "tables": [], "status": f"error: {e}"}


def read_pages(spark: SparkSession, path: str, extract: Extractor = plain_text, pattern: str = "*", most_pages: int = 1000, most_chars: int = 500_000) -> DataFrame:
    """One row a page: filename, page_num, text, status (null: fine), tables. Large files are one task each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = []
                for page in extract(name, bytes(content)):
                    if page["page_num"] > most_pages:
                        break
                    text = next((t for t in page["candidates"] if t and t.strip()), "")
                    status = page.get("status") or (None if text else "image_only" if page.get("tables") else "empty")
                    rows.append((name.rsplit("/", 1)[-1], page["page_num"], text[:most_chars], status, page.get("tables") or []))
                yield pd.DataFrame(rows, columns=["filename", "page_num", "text", "status", "tables"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, PAGE)


def _numbered_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A place from 0 within each split; a task reads the rows of its splits one after the other."""
    last, n = None, 0
    for b in batches:
        places = []
        for split in zip(b.column("path").to_pylist(), b.column("split").to_pylist()):
            last, n = split, (n + 1 if split == last else 0)
            places.append(n)
        yield b.append_column("place", pa.array(places, pa.int64()))


def read_text_pages(spark: SparkSession, path: str, pattern: str = "*", most_pages: int = 1000, most_chars: int = 500_000) -> DataFrame:
    """What read_pages gives with plain_text, for files of any size: Spark's text reader splits them by ranges of bytes, so
    that many tasks read one file, wherever it is stored. The pages of each split are counted first; a page's number is its
    place in its split and the pages of the splits before. A file that ends with a form feed has an empty page behind it,
    as has one without a byte. Bytes that aren't UTF-8 are replaced page by page; a byte order mark is dropped."""
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    raw = spark.read.options(**options).option("lineSep", "\f").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    # a row a split and a row a file
    splits = written(raw.groupBy("path", "split").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes")), "splits", rows=1)
    files = spark.read.format("binaryFile").options(**options).load(path).select(F.col("_metadata.file_path").alias("path"), "length")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path", "split", F.coalesce(before, F.lit(0)).alias("before"))
    schema = "path string, split long, value string, place long"
    pages = raw.select("path", "split", F.make_valid_utf8("value").alias("value")).mapInArrow(_numbered_in_split, schema).join(starts, ["path", "split"])
    read = splits.groupBy("path").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    ends = files.join(read, "path", "left")
    ends = ends.filter(F.col("n").isNull() | (F.col("bytes") <= F.col("length"))).select("path", F.lit("").alias("value"), (F.coalesce("n", F.lit(0)) + 1).alias("page_num"))
    every = pages.select("path", "value", (F.col("place") + F.col("before") + 1).alias("page_num")).unionByName(ends).filter(F.col("page_num") <= most_pages)
    blank = F.trim(F.translate("value", "\t\n\x0b\r\x1c\x1d\x1e\x1f\x85\xa0", " ")) == ""
    text = F.when(blank, F.lit("")).otherwise(F.substring("value", 1, most_chars))
    return every.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("filename"), F.col("page_num").cast("int").alias("page_num"), text.alias("text"), F.when(blank, F.lit("empty")).alias("status"), F.array().cast("array<array<array<string>>>").alias("tables"))


#: Finds tables on one page of a file: (path, content, page number) to tables as lists of rows, or to text that holds
#: them as lines between pipes.
TableFinder = Callable[[str, bytes, int], list | str]
#: Least accuracy, in percent, of a table of the second tier.
ACCURACY = 60


def camelot_tables(path: str, content: bytes, page_num: int) -> list:
    """With camelot, where it is installed: ruled tables, else tables told by white space; none where it isn't."""
    import importlib.util
    import tempfile

    if importlib.util.find_spec("camelot") is None:
        return []
    import camelot

    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # lives as long as the call
        f.write(content)
        f.flush()
        for flavor in ("lattice", "stream"):
            found = [t.df.values.tolist() for t in camelot.read_pdf(f.name, pages=str(page_num), flavor=flavor) if t.accuracy >= ACCURACY and len(t.df) >= 2]
            if found:
                return found
    return []


def found_tables(spark: SparkSession, path: str, wanted: DataFrame, find: TableFinder, extractor: str, pattern: str = "*") -> DataFrame:
    """The tables that a finder sees on the wanted pages (filename, page_num) of the files under path: filename,
    page_num, table_idx, cells, extractor. Only files with a wanted page are read by Python; a page that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content, numbers in zip(b["path"], b["content"], b["numbers"]):
                rows = []
                for n in numbers:
                    try:
                        got = find(name, bytes(content), int(n))
                    except Exception:
                        got = []
                    text = got if isinstance(got, str) else None
                    rows.append((name.rsplit("/", 1)[-1], int(n), text, None if text is not None else [[[None if c is None else str(c) for c in r] for r in t] for t in got]))
                yield pd.DataFrame(rows, columns=["filename", "page_num", "text", "tables"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    pages = wanted.groupBy("filename").agg(F.array_sort(F.collect_set(F.col("page_num").cast("int"))).alias("numbers"))
    named = files.select("path", "content", F.element_at(F.split("path", "/"), -1).alias("filename"))
    found = named.join(pages, "filename").select("path", "content", "numbers").mapInPandas(run, "filename string, page_num int, text string, tables array<array<array<string>>>")
    tables = F.when(F.col("text").isNotNull(), markdown_tables("text")).otherwise(F.col("tables"))
    return found.select("filename", "page_num", F.posexplode(tables).alias("table_idx", "cells")).withColumn("extractor", F.lit(extractor))


def uploads(files: DataFrame, name: str = "filename") -> DataFrame:
    """The files that may be taken in."""
    return files.filter(allowed_file(name))


def raw_tables(pages: DataFrame) -> DataFrame:
    """filename, page_num, table_idx, cells, page_text of each table."""
    return pages.select("filename", "page_num", F.col("text").alias("page_text"), F.posexplode("tables").alias("table_idx", "cells"))


def first_text(*candidates: str) -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.when(strip(c) != "", F.col(c)) for c in candidates], F.lit(""))
