"""Large files read by ranges give the pages that a reader of whole files gives."""

import random

from paperloom.sources import pages


def rows(df):
    return sorted((r.filename, r.page_num, r.text, r.status, r.tables) for r in df.collect())


def test_ranges_give_whole_files_pages(spark, tmp_path):
    src = tmp_path / "in put"
    src.mkdir()
    odd = {"a.txt": "one\ftwo\n é 語\f\f  \n\f", "b+c.txt": "alone", "none.txt": "", "feed.txt": "\f", "d e.txt": "x\f" * 3 + " \t", "sub.dat": "left\fout"}
    for name, text in odd.items():
        (src / name).write_bytes(text.encode())
    (src / "bad.txt").write_bytes(b"ok\f\xff\xfe bytes\fok again")
    rng = random.Random(1)
    (src / "large.txt").write_text("\f".join(f"page {i} " + "é" * rng.randrange(3000) for i in range(900)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = pages.read_text_pages(spark, str(src), "*.txt")
        assert rows(got) == rows(pages.read_pages(spark, str(src), pattern="*.txt"))
        raw = spark.read.option("lineSep", "\f").text(str(src / "large.txt"))
        assert raw.rdd.getNumPartitions() > 10  # so many tasks read the one file
        assert rows(pages.read_text_pages(spark, str(src), "large*", 40, 9)) == rows(pages.read_pages(spark, str(src), pattern="large*", most_pages=40, most_chars=9))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_uploads_land_by_session(spark, tmp_path):
    from paperloom.sources.landing import land, landed, safe_name

    names = {"../../etc/a b.pdf": "etc_a_b.pdf", "Übersicht ß 語.PDF": "Ubersicht_.PDF", "..": "", None: "", "c:\\x\\y.zip": "c_x_y.zip", "._.pdf": "pdf"}
    assert {n: safe_name(n) for n in names} == names
    schema = "session_id long, filename string, content binary"
    target = str(tmp_path / "landing")
    land(spark.createDataFrame([(1, "a.pdf", b"one"), (2, "a.pdf", b"two"), (1, "b.txt", b"no"), (1, None, b"no"), (1, "/ .pdf", b"no"), (None, "n.zip", b"none")], schema), target)
    land(spark.createDataFrame([(1, "a.pdf", b"newer"), (1, " c.pdf", b"c")], schema), target)
    rows = lambda df: sorted(((r.session_id, r.filename, bytes(r.content)) for r in df.collect()), key=repr)
    assert rows(landed(spark, target)) == sorted([("1", "a.pdf", b"newer"), ("1", "c.pdf", b"c"), ("2", "a.pdf", b"two"), (None, "n.zip", b"none")], key=repr)
    assert rows(landed(spark, target, "2")) == [("2", "a.pdf", b"two")]
