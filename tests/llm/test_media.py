import hashlib
import random
import zlib

import numpy as np
import pytest

from paperloom.llm import media
from paperloom.llm.common import new_path

TEXTS = [(1, "abc"), (2, ""), (3, None), (4, "x" * 192), (5, "é" * 97), (6, "long " * 60_000), (None, "abc"), (1, "abc")]


def test_round_trip(documents):
    docs = documents(TEXTS).repartition(3)
    got = sorted((tuple(r) for r in media.media_features(docs).collect()), key=repr)
    want = []
    for i, t in TEXTS:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192) if raw else b" " * 192
        image = media.png(p)
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(np.frombuffer(p, np.uint8).reshape(-1, 192))))
    assert got == sorted(want, key=repr)
    assert media.media_features(docs.limit(0)).count() == 0


def test_ranges_split_archives(spark, documents):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))) for i in range(200)]
    path = new_path(spark, "media")
    assert media.write_archives(documents(rows).coalesce(2), path) <= 2
    spark.dataSource.register(media.ArchiveSource)
    df = spark.read.format("paperloom_archive").option("path", path).option("rangeBytes", "20000").load()
    assert df.rdd.getNumPartitions() > 10
    got = df.collect()
    assert sorted(r.doc_id for r in got) == list(range(200)) and not any(r.error for r in got)
    assert all(media.samples(bytes(r.media)).tobytes() == media.payload(rows[r.doc_id][1].encode()) for r in got)


def test_a_range_is_opened_once(spark, documents, monkeypatch):
    """All members of a range come through one open file, in few reads; only what fails is opened again."""
    path = new_path(spark, "media")
    media.write_archives(documents([(i, f"text {i} " * 50) for i in range(60)]).coalesce(1), path)
    fs, _ = media.filesystem(path)
    opened = []

    class Counted:
        def open_input_file(self, name):
            opened.append(name)
            return fs.open_input_file(name)

        def __getattr__(self, name):
            return getattr(fs, name)

    reader = media.ArchiveReader({"path": path, "rangeBytes": "2000"})
    (_, root) = media.filesystem(path)

    class Listed(Counted):
        def get_file_info(self, selector):
            return fs.get_file_info(selector)

    monkeypatch.setattr(media, "filesystem", lambda uri: (Listed(), root))
    assert len(reader.partitions()) > 4 and not opened  # planning lists, and opens nothing
    assert sorted(r for p in reader.partitions() for b in reader.read(p) for r in b.column("doc_id").to_pylist()) == list(range(60))
    opened.clear()
    reader = media.ArchiveReader({"path": path})
    (whole,) = reader.partitions()
    assert [r for b in reader.read(whole) for r in b.column("doc_id").to_pylist()] == list(range(60)) and len(opened) == 1
    monkeypatch.setattr(media, "BATCH_BYTES", 500)
    assert sum(b.num_rows for b in reader.read(whole)) == 60 and len(opened) == 2


def test_members_are_tried_alone(spark, documents):
    path = new_path(spark, "media")
    media.write_archives(documents([(i, f"text {i}" * 9) for i in range(5)]).coalesce(1), path)
    fs, root = media.filesystem(path)
    name = f"{root}/archive-000000.zip"
    member = media.read_archives(spark, path).filter("doc_id = 3").first()
    data = bytearray(open(name, "rb").read())
    data[data.index(bytes(member.media)) + 60] ^= 1
    open(name, "wb").write(data)
    got = {r.doc_id: r for r in media.read_archives(spark, path).collect()}
    assert got[3].error and got[3].media is None and all(got[i].error is None for i in (0, 1, 2, 4))


def test_member_is_read_again(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", b"content")
        info = z.infolist()[0]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return open(tmp_path / "a.zip", "rb")

    assert media.read_member(flaky, info) == b"content" and len(tries) == 3
    with pytest.raises(OSError):
        media.read_member(lambda: open(tmp_path / "none", "rb"), info)


def test_damage_is_seen():
    image = bytearray(media.png(media.payload(b"some text")))
    image[50] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(image))
