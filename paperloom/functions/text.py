"""Text rules as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a question as simple, as a section boundary, as a caption, as notes, as a follow-up.
SIMPLE_QUESTION = r"^(what is (the )?|define |meaning of |(maximum|minimum) (temperature|pressure|thickness)|list |name )"
SECTION_BOUNDARY = r"^(\d+\.\d+\s+[A-Z]|[A-Z\s]{10,}$|\d+\s+[A-Z]|APPENDIX\s+[A-Z0-9]|TABLE\s+\d+|FIGURE\s+\d+)"
CAPTION = r"(?i)^(Table|Fig\.|Figure|Table\s+(UCS|UG|UW))[\s\-][\w\-.]+"
NOTES = r"(?i)^(GENERAL\s+)?NOTES?:"
FOLLOWUP_SIGNALS = (
    "it ", "its ", "that ", "those ", "these ", "they ", "the same", "above", "mentioned", "you said", "previous", "also",
    "what about", "and the", "more about", "elaborate", "explain more", "tell me more", "what else", "any other",
    "furthermore", "additionally", "in that case", "so then", "can you", "could you", "please", "how about",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used: an expression that stands several times in a plan, or
    in a lambda, is computed each time, a lambda's variable isn't."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def words(c: Column | str) -> Column:
    """The words between white space."""
    return F.array_remove(F.split(col(c), r"\s+"), "")


def lines(c: Column | str) -> Column:
    return F.split(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def is_upper(c: Column) -> Column:
    """At least one cased letter, and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def section_heading(text: Column | str) -> Column:
    """The first line of 3 to 80 characters that is in upper case, or has a capital first and eight words at most."""

    def fits(line: Column) -> Column:
        first = F.substring(line, 1, 1)
        return F.length(line).between(3, 80) & (is_upper(line) | (is_upper(first) & (F.size(words(line)) <= 8)))

    # most lines are long, and told by their length before a pattern is tried on them; a pattern's end is before a last line end, too
    near = F.filter(lines(text), lambda x: (F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) <= 80) | F.substring(x, -1, 1).isin("\x85", "\u2028", "\u2029"))
    heading = F.try_element_at(F.filter(F.transform(near, lambda x: strip(x)), fits), F.lit(1))
    return F.coalesce(heading, F.lit(""))


def table_title(page_text: Column | str, table_idx: Column) -> Column:
    """The caption with this number from 0 on a page, else the last one, else nothing."""
    captions = F.filter(F.transform(lines(page_text), lambda x: strip(x)), lambda x: x.rlike(CAPTION) & (F.length(x) > 5))
    return F.coalesce(F.get(captions, table_idx), F.try_element_at(captions, F.lit(-1)), F.lit(""))


def table_notes(page_text: Column | str, most: int = 800) -> Column:
    """Lines from the first that begins notes to a short line in upper case; lines that begin notes always stay."""
    zero = F.struct(F.lit(False).alias("on"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        begins = line.rlike(NOTES)
        ends = acc["on"] & ~begins & (line != "") & (F.length(line) < 60) & is_upper(line) & ~line.startswith("(")
        over = acc["over"] | ends
        on = acc["on"] | begins
        return F.struct(on.alias("on"), over.alias("over"), F.when(on & ~over, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.transform(lines(page_text), lambda x: strip(x)), zero, step, lambda acc: F.substring(F.array_join(acc["kept"], " "), 1, most))


def is_section_boundary(text: Column | str) -> Column:
    return strip(text).rlike(SECTION_BOUNDARY)


def query_complexity(query: Column | str) -> Column:
    return F.when(strip(F.lower(col(query))).rlike(SIMPLE_QUESTION), F.lit("simple_factual")).otherwise(F.lit("complex"))


def has_followup_signal(query: Column | str) -> Column:
    q = F.lower(col(query))
    found = F.lit(False)
    for signal in FOLLOWUP_SIGNALS:
        found = found | F.contains(q, F.lit(signal))
    return found


def clean_answer(text: Column | str) -> Column:
    """Without heading marks and trailing white space, runs of blank lines as one."""
    c = F.regexp_replace(col(text), r"(?m)^#+\s*", "")
    c = F.regexp_replace(c, r"[ \t\r\f\u000B]+(?=\n|\z)", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def allowed_file(name: Column | str) -> Column:
    c = col(name)
    return F.contains(c, F.lit(".")) & F.lower(F.substring_index(c, ".", -1)).isin("pdf", "zip")


def first_sentences(text: Column, most: int = 2000, key: int = 60) -> Column:
    """At most so many characters, and of sentences with equal beginnings the first."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        k = F.substring(strip(s), 1, key)
        new = ~F.array_contains(acc["seen"], k)
        return F.struct(F.when(new, F.concat(acc["seen"], F.array(k))).otherwise(acc["seen"]).alias("seen"), F.when(new, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(F.split(cut, r"\. "), zero, step, lambda acc: F.array_join(acc["kept"], ". "))
