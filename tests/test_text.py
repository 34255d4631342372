from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import vectors as V


def values(spark, column, *inputs, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_heading(spark):
    texts = ["AB\nGENERAL NOTES", "a b c\n  Title here \nx", "", "one two", "A b c d e f g h i\nX1", None]
    assert values(spark, T.section_heading, *texts) == ["GENERAL NOTES", "Title here", "", "", "", ""]


def test_captions(spark):
    page = "Table 3-1 Foo\nprose\n  Figure 2 Bar"
    for i, want in ((0, "Table 3-1 Foo"), (1, "Figure 2 Bar"), (5, "Figure 2 Bar")):
        assert values(spark, lambda c: T.table_title(c, F.lit(i)), page) == [want]
    assert values(spark, lambda c: T.table_title(c, F.lit(0)), "Table: x", "", "table UCS-66 curves") == ["", "", "table UCS-66 curves"]


def test_notes(spark):
    assert values(spark, T.table_notes, "x\nNOTES: a\nb\n\nGENERAL\nc", "x\ny", "General Notes: q\n(A) KEPT\nlast") == ["NOTES: a b ", "", "General Notes: q (A) KEPT last"]


def test_boundary(spark):
    assert values(spark, T.is_section_boundary, "3.1 MATERIAL", "GENERAL REQUIREMENTS", "SHORT", "Table 3", "5 Testing", "APPENDIX A", " TABLE 3 x") == [True, True, False, False, True, True, True]


def test_complexity(spark):
    simple, hard = "simple_factual", "complex"
    assert values(spark, T.query_complexity, "What is the X", "the maximum temperature", "Maximum temperature of", "list", "list all") == [simple, hard, simple, hard, simple]


def test_answer(spark):
    assert values(spark, T.clean_answer, "## H\n\n\n\nx  \n\n\ny  \n", "#no heading", "a\n \n \nb") == ["H\n\nx\n\ny", "no heading", "a\n\nb"]


def test_files(spark):
    assert values(spark, T.allowed_file, "a.PDF", "pdf", "a.b.zip", "a.pdf.txt") == [True, False, True, False]


def test_sentences(spark):
    assert values(spark, T.first_sentences, "a. b. a. c", "x" * 2001) == ["a. b. c", "x" * 2000 + "..."]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = df.select(V.normalised("a"), V.normalised("z"), V.cosine("a", "z"), V.cosine("a", "a"), V.blended("a", "a")).first()
    assert got[0] == [0.6, 0.8] and got[1] == [0.0, 0.0] and got[2] == 0.0
    assert abs(got[3] - 1) < 1e-9 and abs(got[4][0] - 0.6) < 1e-12


def test_headings_of_odd_lines(spark):
    """Lines are told by length first; headings are those of the rule without that, and a text is split once for its chunks."""
    from paperloom.functions.text import is_upper, section_heading, strip, words
    from paperloom.operators.chunking import text_chunks

    long_ = "x" * 90
    odd = ["A" * 79 + "  \u2028", "A" * 80 + " \u2029", "B" * 78 + " " * 9 + "\x85", "  Cap " + " " * 99, "\x0b\fDab\x0b", "Ab", "lower\r\r\nUp Here\n" + long_, long_ + "\rÉté 中", "", " \r\n ", "Z" * 81]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*odd, *(f"{long_}\n{o}\nLast One" for o in odd), None])], "i int, text string")
    fits = lambda x: F.length(x).between(3, 80) & (is_upper(x) | (is_upper(F.substring(x, 1, 1)) & (F.size(words(x)) <= 8)))
    plain = F.coalesce(F.try_element_at(F.filter(F.transform(F.split("text", "\r\n|\n|\r"), lambda x: strip(x)), fits), F.lit(1)), F.lit(""))
    got = rows.select(section_heading("text").alias("a"), plain.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and len({r.a for r in got}) > 6
    plan = text_chunks(rows.withColumns({"filename": F.lit("f"), "page_num": F.lit(1)}))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "split" in line for line in plan.splitlines())
