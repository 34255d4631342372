"""Pages to overlapping chunks, chunk numbers, embedding batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import section_heading, words
from paperloom.operators.numbering import with_row_numbers, with_starts

#: Words of a chunk, words that neighbours share, characters that are embedded, chunks of a batch, characters of a page.
CHUNK_WORDS, OVERLAP, EMBED_CHARS, BATCH, PAGE_CHARS, MAX_PAGES = 400, 80, 15_000, 16, 500_000, 1_000
TOKENS_A_WORD, TOKENS_A_MINUTE = 1.3, 10_000_000


def pages_from_documents(docs: DataFrame) -> DataFrame:
    """documents as pages: a source is a file, a document one of its pages."""
    return docs.select(F.col("source").alias("filename"), F.col("doc_id").alias("page_num"), "text")


def limited_pages(pages: DataFrame, most_pages: int = MAX_PAGES, most_chars: int = PAGE_CHARS) -> DataFrame:
    """The first pages of each file, each with the first characters of its text."""
    return pages.filter(F.col("page_num") <= most_pages).withColumn("text", F.substring("text", 1, most_chars))


def source_label(filename: str = "filename", page: str = "page_num") -> Column:
    return F.concat(F.col(filename), F.lit(" - Page "), F.col(page).cast("string"))


def text_chunks(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """pages: filename, page_num, text. One row a window of words: filename, page_num, chunk_seq, source, chunk_type,
    text. The last window of a page is the one that reaches its end. A page is one row, so nothing is shuffled."""
    return _windows(pages, size, overlap)


def _windows(pages: DataFrame, size: int, overlap: int, *more: str) -> DataFrame:
    step = size - overlap
    split = pages.select("filename", "page_num", *more, words("text").alias("words"), section_heading("text").alias("heading"))
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - overlap - 1), F.lit(step)))
    # outer, as a filter before it would split each text again
    rows = split.select("filename", "page_num", *more, "words", "heading", F.posexplode_outer(starts).alias("chunk_seq", "start")).filter("start is not null")
    body = F.array_join(F.slice("words", F.col("start") + 1, size), " ")
    text = F.when(F.col("heading") != "", F.concat(F.lit("Section: "), "heading", F.lit("\n"), body)).otherwise(body)
    return rows.select("filename", "page_num", "chunk_seq", source_label().alias("source"), F.lit("text").alias("chunk_type"), text.alias("text"), *more)


def numbered_text_chunks(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP, start: int = 0) -> DataFrame:
    """text_chunks with chunk_id in the order of file, page and place, from how many chunks each page has: no text is moved
    or sorted for it. Where pages repeat (filename, page_num), chunks are sorted as they are."""
    n_words = F.size(words("text"))
    n = F.when(n_words > 0, F.floor(F.greatest(F.lit(0), n_words - overlap - 1) / (size - overlap)) + 1).otherwise(0)
    placed = with_starts(pages, ["filename", "page_num"], F.coalesce(n, F.lit(0)), "first_id", start)
    if placed is None:
        return numbered(text_chunks(pages, size, overlap), start=start)
    rows = _windows(placed, size, overlap, "first_id")
    return rows.select((F.col("first_id") + F.col("chunk_seq")).alias("chunk_id"), *[c for c in rows.columns if c != "first_id"])


def numbered(chunks: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """chunk_id from start, in the order of the columns given; by default file, page, place."""
    return with_row_numbers(chunks, list(order) or ["filename", "page_num", "chunk_seq"], "chunk_id", start)


def embed_texts(chunks: DataFrame, most: int = EMBED_CHARS) -> DataFrame:
    """What goes to the embedder; the stored text stays whole."""
    return chunks.withColumn("embed_text", F.substring("text", 1, most))


def batch_rows(chunks: DataFrame, text: str, size: int = BATCH) -> DataFrame:
    """chunks: chunk_id (consecutive within a file), filename and the text column. Batches of up to size consecutive chunks
    of a file as rows: filename, batch, ids, texts, in the order of chunk_ids. A group is one batch, never a file."""
    first = chunks.groupBy("filename").agg(F.min("chunk_id").alias("first_id"))
    dealt = chunks.select("filename", "chunk_id", F.col(text).alias("text")).join(first, "filename").withColumn("batch", F.floor((F.col("chunk_id") - F.col("first_id")) / size))
    rows = dealt.groupBy("filename", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("rows"))
    return rows.select("filename", "batch", F.col("rows.chunk_id").alias("ids"), F.col("rows.text").alias("texts"))


def piece_rows(chunks: DataFrame, text: str, tasks: int, size: int = BATCH) -> DataFrame:
    """batch_rows within pieces (a column) of consecutive chunks, each small enough for a task: texts are moved once, to their
    piece's task. Gives piece, filename, batch, ids, texts."""
    dealt = chunks.select("piece", "filename", "chunk_id", F.col(text).alias("text")).repartition(tasks, "piece")
    place = F.col("chunk_id") - F.min("chunk_id").over(Window.partitionBy("piece", "filename"))
    rows = dealt.withColumn("batch", F.floor(place / size)).groupBy("piece", "filename", "batch").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("rows"))
    return rows.select("piece", "filename", "batch", F.col("rows.chunk_id").alias("ids"), F.col("rows.text").alias("texts"))


def embed_batches(chunks: DataFrame, size: int = BATCH) -> DataFrame:
    """Batches of consecutive chunks (with chunk_id) within a file: filename, batch, n_chunks, token_estimate,
    pause_seconds. A chunk's place in its file is its number less the file's first, so no file is sorted in one task."""
    first = chunks.groupBy("filename").agg(F.min("chunk_id").alias("first_id"))
    dealt = chunks.join(first, "filename").withColumn("batch", F.floor((F.col("chunk_id") - F.col("first_id")) / size).cast("int"))
    cut = F.max(F.length("text") > EMBED_CHARS)
    tokens = F.sum(F.size(words(F.substring("text", 1, EMBED_CHARS)))) * F.lit(TOKENS_A_WORD)
    pause = tokens / F.lit(TOKENS_A_MINUTE) * 60
    return dealt.groupBy("filename", "batch").agg(F.count("*").alias("n_chunks"), tokens.alias("token_estimate"), F.when(~cut & (pause > 0.1), pause).otherwise(F.lit(0.0)).alias("pause_seconds"))
