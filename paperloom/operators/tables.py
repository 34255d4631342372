"""Tables found on pages: array<array<string>> columns, row 0 the header. All rules are array expressions; a page or a
table is one row, so nothing is shuffled until chunks are numbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import bound, col, lines, strip, table_notes, table_title
from paperloom.operators.chunking import text_chunks

LEAST_QUALITY = 0.4
#: A header with this share of labels is taken as complete; data rows that vote; votes that a column needs.
FULL_HEADER, VOTERS, VOTES = 0.6, 5, 2
CELLS = "array<array<string>>"


def markdown_tables(text: Column | str) -> Column:
    """Blocks of lines that begin with a pipe, of two rows or more, as an array of tables. Separator lines are passed
    over: they neither count nor end a block."""
    zero = F.struct(F.array().cast(CELLS).alias("now"), F.array().cast(f"array<{CELLS}>").alias("done"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["now"]) >= 2, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        row = line.startswith("|")
        separator = row & F.replace(line, F.lit(" "), F.lit("")).rlike(r"^\|[\s\-:|]+\|$")
        cells = F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), lambda c: strip(c))
        now = F.when(separator, acc["now"]).when(row, F.concat(acc["now"], F.array(cells))).otherwise(F.array().cast(CELLS))
        return F.struct(now.alias("now"), F.when(row, acc["done"]).otherwise(closed(acc)).alias("done"))

    return F.aggregate(F.transform(lines(text), lambda x: strip(x)), zero, step, closed)


def _filled(cell: Column) -> Column:
    return F.coalesce(strip(cell) != "", F.lit(False))


def collapsed(cells: Column | str) -> Column:
    """Columns that a wide header merged, as logical columns. With a mostly complete header, or none, only white space
    is tidied. Else the columns that at least two of the first data rows fill stay, as many as there are labels, each
    under the nearest label (the left one of two); if no column does, the labels' own columns stay."""
    def voted(c: Column, a: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.array_max(F.transform(a["voters"], lambda r: F.size(r))) - 1, F.lit(0)))
        some = F.filter(places, lambda i: F.size(F.filter(a["voters"], lambda r: _filled(F.get(r, i)))) >= VOTES)
        return bound(some, lambda v: F.when(F.size(v) > 0, F.slice(v, 1, F.size(a["labels"]))).otherwise(a["labels"]))

    def merged(c: Column, a: Column, chosen: Column) -> Column:
        def label(i: Column) -> Column:
            nearest = F.get(F.array_sort(F.transform(a["labels"], lambda h: F.struct(F.abs(h - i).alias("d"), h.alias("h")))), F.lit(0))["h"]
            return strip(F.get(a["header"], nearest))

        rows = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), lambda r: F.transform(chosen, lambda i: F.coalesce(strip(F.replace(F.get(r, i), F.lit("\n"), F.lit(" "))), F.lit(""))))
        return F.concat(F.array(F.transform(chosen, label)), rows)

    def of(c: Column) -> Column:
        plain = F.transform(c, lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit(""))))
        tidy = F.transform(c, lambda r: F.transform(r, lambda x: F.coalesce(strip(F.replace(x, F.lit("\n"), F.lit(" "))), F.lit(""))))
        header = F.get(c, F.lit(0))
        labels = F.filter(F.sequence(F.lit(0), F.greatest(F.size(header) - 1, F.lit(0))), lambda i: _filled(F.get(header, i)))
        parts = F.struct(header.alias("header"), labels.alias("labels"), F.slice(c, 2, VOTERS).alias("voters"))
        complete = lambda a: (F.size(a["labels"]) == 0) | (F.size(a["labels"]) / F.greatest(F.size(a["header"]), F.lit(1)) >= FULL_HEADER)
        wide = bound(parts, lambda a: F.when(complete(a), tidy).otherwise(bound(voted(c, a), lambda chosen: merged(c, a, chosen))))
        return F.when(F.size(c) < 2, plain).otherwise(wide)

    return bound(col(cells), of)


def quality(cells: Column | str) -> Column:
    """0 to 1: how much of the data is filled, and whether there are three columns."""

    def of(c: Column) -> Column:
        headers = F.size(F.filter(F.get(c, F.lit(0)), _filled))
        data = F.flatten(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))))
        fill = F.size(F.filter(data, _filled)) / F.greatest(F.size(data), F.lit(1))
        return F.when(F.size(c) < 2, 0.0).when(headers < 2, 0.1).otherwise(F.round(0.7 * fill + 0.3 * F.least(headers / 3, F.lit(1.0)), 3))

    return bound(col(cells), of)


def accepted(tables: DataFrame, fallback: DataFrame | None = None, least: float = LEAST_QUALITY) -> DataFrame:
    """tables (filename, page_num, table_idx, cells, extractor): collapsed and scored, those that are good enough. A page
    with a table that isn't also takes the fallback's tables, scored alike; a page with none takes them as they are."""
    scored = tables.withColumn("cells", collapsed("cells")).withColumn("quality", quality("cells"))
    good = scored.filter(F.col("quality") >= least)
    if fallback is None:
        return good
    poor = scored.filter(F.col("quality") < least).select("filename", "page_num").distinct()
    any_ = tables.select("filename", "page_num").distinct()
    again = fallback.withColumn("cells", collapsed("cells")).withColumn("quality", quality("cells"))
    second = again.join(poor, ["filename", "page_num"], "left_semi").filter(F.col("quality") >= least)
    third = fallback.withColumn("quality", F.lit(None).cast("double")).join(any_, ["filename", "page_num"], "left_anti")
    return good.unionByName(second).unionByName(third)


def grid(cells: Column | str) -> Column:
    """The table as text with rules between rows; cells are left as they are, columns as wide as their widest."""

    def of(c: Column) -> Column:
        columns = F.array_max(F.transform(c, lambda r: F.size(r)))
        places = F.sequence(F.lit(0), F.greatest(columns - 1, F.lit(0)))
        widths = F.transform(places, lambda i: F.struct(i.alias("i"), F.array_max(F.transform(c, lambda r: F.coalesce(F.length(F.get(r, i)), F.lit(0)))).alias("w")))
        return bound(widths, lambda w: drawn(c, w))

    def rule(widths: Column, mark: str) -> Column:
        return F.concat(F.lit("+"), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit(mark), w["w"] + 2)), "+"), F.lit("+"))

    def line(r: Column, widths: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.rpad(F.coalesce(F.get(r, w["i"]), F.lit("")), w["w"], " ")), " | "), F.lit(" |"))

    def drawn(c: Column, widths: Column) -> Column:
        def body(thin: Column) -> Column:
            rows = F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), lambda r: F.concat(line(r, widths), F.lit("\n"), thin))
            return F.concat(thin, F.lit("\n"), line(F.get(c, F.lit(0)), widths), F.lit("\n"), rule(widths, "="), bound(rows, lambda x: F.when(F.size(x) > 0, F.concat(F.lit("\n"), F.array_join(x, "\n"))).otherwise(F.lit(""))))

        return bound(rule(widths, "-"), body)

    return bound(col(cells), of)


def headers_of(cells: Column | str) -> Column:
    """The labels without the blank ones; cells are then taken by place among these, so that values shift past a blank
    label."""
    return F.filter(F.transform(F.get(col(cells), F.lit(0)), lambda h: strip(h)), lambda h: F.coalesce(h != "", F.lit(False)))


def row_text(headers: Column, row: Column) -> Column:
    """Label and value of what is filled; of equal labels the last one's value stands in the first one's place."""

    def value(h: Column) -> Column:
        last = F.size(headers) - F.array_position(F.reverse(headers), h).cast("int")
        return F.coalesce(strip(F.get(row, last)), F.lit(""))

    parts = F.transform(F.array_distinct(headers), lambda h: F.struct(h.alias("h"), value(h).alias("v")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["v"] != ""), lambda p: F.concat(p["h"], F.lit(": "), p["v"])), " | ")


def table_chunks(tables: DataFrame) -> DataFrame:
    """tables: filename, page_num, table_idx, cells, and page_text for caption and notes. Chunks in order (seq): the
    whole table, then each filled row, and after every third such row a chunk of the rows around it. The combined
    chunk's label is two rows behind what it holds; retrieval depends on neither."""
    t = tables.withColumn("headers", headers_of("cells")).filter((F.size("cells") >= 2) & (F.size("headers") > 0))
    title, notes = table_title("page_text", F.col("table_idx")), table_notes("page_text")
    t = t.withColumn("prefix", F.when(title != "", F.concat(title, F.lit("\n"))).otherwise(F.lit(""))).withColumn("suffix", F.when(notes != "", F.concat(F.lit("\n"), notes)).otherwise(F.lit("")))
    t = t.withColumn("rows", F.transform(F.slice("cells", 2, F.size("cells") - 1), lambda r: row_text(F.col("headers"), r)))
    base = F.concat("filename", F.lit(" - Page "), F.col("page_num").cast("string"), F.lit(" - Table "), (F.col("table_idx") + 1).cast("string"))
    columns = F.concat(F.lit("Table columns: "), F.array_join("headers", " | "), F.lit("\n"))
    kind = "array<struct<seq:int,row_kind:string,source:string,chunk_type:string,text:string>>"

    def chunk(seq: Column, row_kind: str, source: Column, chunk_type: str, text: Column) -> Column:
        return F.struct(seq.cast("int").alias("seq"), F.lit(row_kind).alias("row_kind"), source.alias("source"), F.lit(chunk_type).alias("chunk_type"), text.alias("text"))

    whole = F.concat("prefix", F.lit("Complete table (page "), F.col("page_num").cast("string"), F.lit(", table "), (F.col("table_idx") + 1).cast("string"), F.lit("):\n"), grid("cells"), "suffix")
    full = chunk(F.lit(0), "full", F.concat(base, F.lit(" (full)")), "table-full", whole)

    def of_row(i: Column) -> Column:
        text = F.get("rows", i - 1)
        n = i.cast("string")
        single = chunk(2 * i, "row", F.concat(base, F.lit(", Row "), n), "table-row", F.concat("prefix", columns, F.lit("Row "), n, F.lit(": "), text))
        span = F.concat(F.greatest(i - 2, F.lit(1)).cast("string"), F.lit("-"), n)
        near = F.filter(F.slice("rows", F.greatest(i - 1, F.lit(1)), 3), lambda x: x != "")
        triple = chunk(2 * i + 1, "triple", F.concat(base, F.lit(", Rows "), span), "table-row", F.concat(columns, F.lit("Rows "), span, F.lit(": "), F.array_join(near, " ; ")))
        return F.when(text == "", F.array().cast(kind)).when(i % 3 == 0, F.array(single, triple)).otherwise(F.array(single))

    chunks = F.concat(F.array(full), F.flatten(F.transform(F.sequence(F.lit(1), F.size("rows")), of_row)))
    return t.select("filename", "page_num", "table_idx", F.explode(chunks).alias("c")).select("filename", "page_num", "table_idx", "c.*")


def carried_titles(tables: DataFrame) -> DataFrame:
    """tables: filename, page_num, table_idx, page_text. title is the page's caption for the table; without one, the
    last title of the file so far, marked as continued. Captions of pages without a table don't count."""
    own = tables.withColumn("own", F.nullif(table_title("page_text", F.col("table_idx")), F.lit("")))
    order = Window.partitionBy("filename").orderBy("page_num", "table_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("own", ignorenulls=True).over(order)
    return own.withColumn("title", F.coalesce("own", F.concat(last, F.lit(" (continued)")), F.lit(""))).drop("own")


def pages_with_grids(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Each page's text followed by its tables as text, in order."""
    added = tables.groupBy("filename", "page_num").agg(F.array_sort(F.collect_list(F.struct("table_idx", grid("cells").alias("g")))).alias("grids"))
    out = pages.join(added, ["filename", "page_num"], "left")
    return out.withColumn("text", F.concat_ws("\n", "text", F.transform("grids", lambda g: g["g"]))).drop("grids")


def poor_pages(pages: DataFrame, tables: DataFrame, least: float = LEAST_QUALITY) -> DataFrame:
    """filename, page_num of the pages for which the next tier of extractors is worth a try: those without a table, and
    those with one that isn't good enough."""
    scored = tables.select("filename", "page_num", (quality(collapsed("cells")) < least).alias("poor"))
    worst = scored.groupBy("filename", "page_num").agg(F.max("poor").alias("poor"))
    out = pages.select("filename", "page_num").join(worst, ["filename", "page_num"], "left")
    return out.filter(F.coalesce("poor", F.lit(True))).select("filename", "page_num")


def page_chunks(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """All chunks of pages (filename, page_num, text) with their accepted tables (filename, page_num, table_idx, cells):
    filename, page_num, kind (0: of a table, 1: of the text), table_idx, chunk_seq, source, chunk_type, text. A table
    without a caption carries the last one of its file; the text's chunks hold the tables as grids."""
    texts = text_chunks(pages_with_grids(pages.select("filename", "page_num", "text"), tables))
    placed = tables.select("filename", "page_num", "table_idx", "cells").join(pages.select("filename", "page_num", F.col("text").alias("page_text")), ["filename", "page_num"])
    # titles need a file's pages in one task, chunks don't: few files would leave them to as many tasks
    titled = carried_titles(placed).repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "filename", "page_num", "table_idx")
    carried = (F.col("title") != "") & (table_title("page_text", F.col("table_idx")) == "")
    of_tables = table_chunks(titled.withColumn("page_text", F.when(carried, F.concat_ws("\n", "title", "page_text")).otherwise(F.col("page_text"))))
    of_tables = of_tables.select("filename", "page_num", F.lit(0).alias("kind"), "table_idx", F.col("seq").alias("chunk_seq"), "source", "chunk_type", "text")
    return of_tables.unionByName(texts.select("filename", "page_num", F.lit(1).alias("kind"), F.lit(0).alias("table_idx"), "chunk_seq", "source", "chunk_type", "text"))
