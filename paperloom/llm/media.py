"""Media columns: archives of images written by tasks, and a Spark data source that streams their members back.

A payload is stored as the samples of an 8-bit grey PNG, WIDTH to a row. Each task writes its images as members of one
zip archive in a folder that all executors share. The data source `paperloom_archive` lists the folder, opens nothing, and
plans partitions as byte ranges of each archive's size; a task opens the archive once, reads its directory, and streams the members whose header lies in its range: one read of neighbouring members an Arrow batch
of bounded size. A member that such a read doesn't bring whole is tried again on its own, from its offset, through a
newly opened file; one that still fails comes as a row with its error.

Nulls and edge cases: a null text counts as empty and becomes one row of spaces; null doc_ids stay null; repeated rows
are members of their own; a partition without rows writes nothing, an empty table gives no rows; a very long text is one
image, held by its task alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from paperloom.llm.common import filesystem, new_path, prepare, publish, release

WIDTH = 192
#: Bytes of a read partition and of an Arrow batch; tries of a member.
RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 4 << 20, 3
_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    """The text, filled with spaces to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(samples: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter: none
    raw[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """Rows of samples of an 8-bit grey PNG without filters or interlacing; every chunk's check sum is tested."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, color, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, color) != (8, 0):
                raise ValueError("not 8-bit grey")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:]


def feature(grey: np.ndarray) -> str:
    """Size, a 64-bit hash that tells which cells of an 8 x 8 grid are lighter than the mean, and mean and deviation."""
    h, w = grey.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = grey.cumsum(0, dtype=np.int64).cumsum(1)
    r0, c0 = np.arange(8) * h // 8, np.arange(8) * w // 8
    r1, c1 = np.maximum(np.arange(1, 9) * h // 8, r0 + 1), np.maximum(np.arange(1, 9) * w // 8, c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    cell = sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]
    light = cell * (h * w) > int(sums[-1, -1]) * area
    mean = int(sums[-1, -1]) / (h * w)
    return f"{w}x{h}:{int.from_bytes(np.packbits(light.ravel()).tobytes(), 'big'):016x}:{mean:.3f}:{float(grey.std()):.3f}"


def write_archives(docs: DataFrame, path: str) -> int:
    """Write docs (doc_id, text) as archives under path, one a partition, and return how many. A task that runs again
    writes the same archive, which takes its name when whole."""
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release()
        fs, root = filesystem(path)
        context = TaskContext.get()
        name = f"{root}/archive-{context.partitionId():06d}"
        out = archive = None
        n = 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if archive is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                data = text or b""
                archive.writestr(zipfile.ZipInfo(f"{n}_{'' if doc_id is None else doc_id}_{len(data)}.png"), png(payload(data)))
                n += 1
        if archive is not None:
            archive.close()
            out.close()
            publish(fs, f"{name}.{context.taskAttemptId()}.tmp", f"{name}.zip")
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(write, "n long").count()


class _Range(InputPartition):
    def __init__(self, archive: str, lo: int, hi: int):
        self.archive, self.lo, self.hi = archive, lo, hi


def member_data(block: bytes, at: int, info: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes in a block of the archive, its header at a place there; its check sum is tested."""
    head = block[at : at + 30]
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member here")
    name, extra = struct.unpack("<HH", head[26:30])
    at += 30 + name + extra
    data = block[at : at + info.file_size]
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("the check sum differs")
    return data


#: Bytes of a member's header beside its name and data, at most: what zip writers add.
_SLACK = 30 + 64


def read_member(open_file, info: zipfile.ZipInfo, tries: int = TRIES) -> bytes:
    """A stored member's bytes from its offset; each try opens the file anew."""
    for left in reversed(range(tries)):
        try:
            with open_file() as f:
                f.seek(info.header_offset)
                return member_data(f.read(_SLACK + len(info.filename.encode()) + info.file_size), 0, info)
        except (OSError, ValueError):
            if not left:
                raise
    raise AssertionError


def neighbours(members: list[zipfile.ZipInfo], most: int) -> Iterator[list[zipfile.ZipInfo]]:
    """Members in the order of their places, in runs of about most bytes; a larger one is a run of its own."""
    run: list[zipfile.ZipInfo] = []
    size = 0
    for info in sorted(members, key=lambda i: i.header_offset):
        if run and size + info.file_size > most:
            yield run
            run, size = [], 0
        run.append(info)
        size += info.file_size
    if run:
        yield run


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        out: list[InputPartition] = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)), key=lambda i: i.path):
            if info.is_file and info.path.endswith(".zip"):
                # the directory at the end has no members: a last range may be without any
                out += [_Range(info.path, lo, min(info.size, lo + self.range_bytes)) for lo in range(0, info.size, self.range_bytes)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.archive) as f:
            with zipfile.ZipFile(f) as z:  # reads the directory; leaves the file open
                mine = [i for i in z.infolist() if partition.lo <= i.header_offset < partition.hi]
            for run in neighbours(mine, BATCH_BYTES):
                first, last = run[0].header_offset, run[-1]
                try:
                    f.seek(first)
                    block = f.read(last.header_offset - first + _SLACK + len(last.filename.encode()) + last.file_size)
                except OSError:
                    block = b""
                yield self._batch([self._row(partition.archive, info, block, info.header_offset - first, fs) for info in run])

    @staticmethod
    def _row(archive: str, info: zipfile.ZipInfo, block: bytes, at: int, fs) -> tuple:
        _, doc_id, n = info.filename.removesuffix(".png").split("_")
        data = error = None
        try:
            try:
                data = member_data(block, at, info)
            except ValueError:
                data = read_member(lambda: fs.open_input_file(archive), info)
        except (OSError, ValueError) as e:
            error = str(e)
        return int(doc_id) if doc_id else None, int(n), archive, info.header_offset, data, error

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "archive", "offset", "media", "error"])


class ArchiveSource(DataSource):
    """Options: path (a folder of archives), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "paperloom_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, archive string, offset long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("paperloom_archive").option("path", path).load()


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for doc_id, n, media, error in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error"))):
            if error:
                raise OSError(f"document {doc_id}: {error}")
            grey = samples(media)
            data = grey.tobytes()
            rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(grey)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, types)], names)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every text of docs (doc_id, text) as media, read it back, and return what the stored bytes give."""
    spark = prepare(docs.sparkSession)
    path = new_path(spark, "media")
    write_archives(docs, path)
    return read_archives(spark, path).mapInArrow(_features, OUT)
