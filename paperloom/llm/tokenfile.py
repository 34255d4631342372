"""Token-ID / binary output: ids in the fewest bits that the vocabulary needs, in files with block offsets.

A file holds, in ascending doc_id order: a header, blocks of bit-packed ids (each starts at a whole byte), the blocks'
offsets, the documents' ids, null marks and starts, and a fixed trailer that says where these lie. A reader gets any
range of ids from the blocks that hold it.

Tasks write one range of documents each, sized by documents and by stored bytes. Documents of one doc_id (or of none)
come in the order of their texts' hashes and may be spread over ranges; rows that repeat both are the same wherever they
lie. Where a file's ids begin in all ids is summed up in Spark, in two levels.

Nulls and edge cases: a null text counts as empty (its document then holds the end id alone); null doc_ids come first
and stay null; repeated rows each get a place; a very long text is held whole by its task; an empty table gives no file
and no row; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm import wordids
from paperloom.llm.common import filesystem, new_path, prepare, publish, strings, written

MAGIC = b"PLBITS01"
BLOCK_IDS = 1 << 16
TRAILER = struct.Struct("<QQQQII8s")  # ids, documents, offset of the block table, offset of the documents, block, bits
#: Documents of a file and bytes that they take where they are stored, about; files whose ids are summed up in one row.
FILE_DOCS, FILE_BYTES, FILES_A_BLOCK = 8192, 16 << 20, 1024


def bits_for(vocab: int) -> int:
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at a fixed width, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(planes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The inverse of pack: each id is cut from the five bytes that hold it (bits <= 32), all at once."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = np.arange(n, dtype=np.int64) * bits
    byte, word = at >> 3, np.zeros(n, np.uint64)
    for k in range(5):
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams ids into one file; holds one block."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at, self.ids = out, bits, 0, 0
        self.blocks: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = [0]
        self.parts: list[np.ndarray] = []
        self.waiting = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        self._put(pack(ids, self.bits))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            self._blocks(self.waiting // BLOCK_IDS * BLOCK_IDS)

    def _blocks(self, n: int) -> None:
        """Write the first n waiting ids."""
        rest = np.concatenate(self.parts).astype(np.uint32) if self.parts else np.zeros(0, np.uint32)
        if len(rest) and int(rest.max()) >> self.bits:
            raise ValueError(f"an id needs more than {self.bits} bits")
        for lo in range(0, n, BLOCK_IDS):
            self._block(rest[lo : min(n, lo + BLOCK_IDS)])
        self.parts, self.waiting = [rest[n:].copy()], len(rest) - n

    def close(self) -> None:
        self._blocks(self.waiting)
        table = self.at
        self._put(np.array(self.blocks, "<u8").tobytes())
        docs = self.at
        self._put(np.array([x or 0 for x in self.docs], "<i8").tobytes())
        self._put(np.array([x is None for x in self.docs], "u1").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(TRAILER.pack(self.ids, len(self.docs), table, docs, BLOCK_IDS, self.bits, MAGIC))


class Reader:
    """Random access to the ids of one file. f: a seekable binary file."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - TRAILER.size)
        self.ids, n, table, docs, self.block, self.bits, magic = TRAILER.unpack(f.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        f.seek(table)
        self.blocks = np.frombuffer(f.read(docs - table), "<u8")
        self.doc_ids = np.frombuffer(f.read(8 * n), "<i8")
        self.null = np.frombuffer(f.read(n), "u1").astype(bool)
        self.starts = np.frombuffer(f.read(8 * (n + 1)), "<u8").astype(np.int64)
        self._last = (-1, np.zeros(0, np.uint32))

    def _get(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            n = min(self.block, self.ids - k * self.block)
            self.f.seek(int(self.blocks[k]))
            self._last = k, unpack(self.f.read((n * self.bits + 7) // 8), n, self.bits)
        return self._last[1]

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (not included) of the file."""
        parts = [self._get(k)[max(lo - k * self.block, 0) : hi - k * self.block] for k in range(lo // self.block, -(-hi // self.block))] if hi > lo else []
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.slice(int(self.starts[i]), int(self.starts[i + 1]))


def stored_bytes(df: DataFrame) -> int:
    """What the optimizer knows of df's size; 0 where it knows nothing."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 60 else 0


def write_ids(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, path: str, file_docs: int = FILE_DOCS) -> DataFrame:
    """Encode documents (doc_id, text) and write files under path in ascending doc_id order. Each task encodes and
    writes one range of documents; the only shuffle moves the texts there. Returns the files (path) with the number of
    ids before each (before). A task that runs again writes the same file, which takes its name when whole."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = docs.count()
    ranges = max(1, min(count, max(-(-count // file_docs), -(-stored_bytes(docs) // FILE_BYTES))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = wordids.load(tokenizer, pattern)
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{root}/ids-{context.partitionId():06d}"
        end, out, w = np.array([end_id], "<u4").tobytes(), None, None
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                if w is None:
                    out = fs.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp")
                    w = Writer(out, bits_for(max(encode.vocab_size, end_id + 1)))
                w.add(doc_id, np.frombuffer(encode(text) + end, "<u4"))
        if w is not None:
            w.close()
            out.close()
            publish(fs, f"{name}.{context.taskAttemptId()}.tmp", f"{name}.bin")
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "n": [w.ids]}, pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    order = [F.col("doc_id").asc_nulls_first(), "text_hash", "spot"]
    keyed = docs.withColumns({"text_hash": F.xxhash64("text"), "spot": F.monotonically_increasing_id()})
    parts = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, "part int, n long")
    return with_starts(written(parts, "files", rows=ranges, dealt=True), path)


def with_starts(parts: DataFrame, path: str) -> DataFrame:
    """parts: part, n. Each file's path and the number of ids before it, by blocks of files and within these."""
    parts = parts.withColumn("block", F.floor(F.col("part") / FILES_A_BLOCK))
    all_before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for FILES_A_BLOCK files
    blocks = parts.groupBy("block").agg(F.sum("n").alias("total")).select("block", F.coalesce(F.sum("total").over(all_before), F.lit(0)).alias("start"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    name = F.format_string(path.replace("%", "%%") + "/ids-%06d.bin", "part")
    return parts.withColumn("within", before).join(blocks, "block").select(name.alias("path"), (F.col("start") + F.col("within")).alias("before"))


def read_digests(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row a document from the files (path, before): doc_id, start, n_tokens, ids_crc32, and the width in bits."""
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    r = Reader(f)
                    n = np.diff(r.starts)
                    crc = [zlib.crc32(r.document(i).astype("<u4").tobytes()) for i in range(len(n))]
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64(), mask=r.null), pa.array(r.starts[:-1] + before, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([r.bits] * len(n), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "bits"])

    return files.repartition(max(1, files.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, bits int")


def token_files(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2) -> DataFrame:
    """Write documents as files in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    return read_digests(spark, write_ids(docs, tokenizer, pattern, end_id, new_path(spark, "ids")))
