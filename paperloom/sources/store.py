"""The stored index: Parquet folders, and a manifest of versions that says which of them a version has."""

from __future__ import annotations

import json
import time
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.sources.commits import create_if_absent, names, place, read_text

VERSION, SIMILARITY = 2, "cosine"
#: Bytes that go through the driver at once when a store is packed or unpacked.
BLOCK = 4 << 20
TABLES = ("chunk", "vector", "posting", "block", "terms", "corpus")
#: Columns that count chunks, which a commit moves on.
PLACES = ("chunk_id", "block")
#: Times that a commit begins anew because another writer was first.
TRIES = 200

#: The tables that a version's own are made from, given the tables of the version before.
Rebase = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Store:
    """Rows of a table stand under path/<table>/append=<folder>; a version is a file manifest/<number>.json, which is
    written last, only if no one else wrote that number, and lists the folders of each table. So a reader sees a whole
    version or the one before, an append writes new rows only, and two writers at once both find their rows in the end:
    the later one reads the other's version and commits on top of it. Appended rows carry chunk_ids from 0; the commit
    says what is added to them, so that numbers go on without gaps and nothing is written again. Paths may be in any
    store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        return place(self.spark, path)

    def exists(self, name: str = "manifest") -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]

    def _version_path(self, number: int) -> str:
        return f"{self.path}/manifest/{number:012d}.json"

    def manifest(self, number: int | None = None) -> dict:
        """A version's row, by default the last one's; empty where there is none."""
        found = self.versions()
        if number is None and found:
            number = found[-1]
        return json.loads(read_text(self.spark, self._version_path(number))) if number in found else {}

    def history(self) -> DataFrame:
        """A row a version: number, chunk_count, next_id, embedding_dim, written."""
        rows = [json.loads(read_text(self.spark, self._version_path(n))) for n in self.versions()]
        return self.spark.createDataFrame([(r["number"], r["chunk_count"], r["next_id"], r["embedding_dim"], r["written"]) for r in rows], "number long, chunk_count long, next_id long, embedding_dim int, written double")

    def folder(self, table: str, folder: str) -> str:
        return f"{self.path}/{table}/append={folder}"

    def new_folder(self) -> str:
        return f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"

    def save(self, tables: dict[str, DataFrame], dim: int, append: tuple[str, ...] = (), rebase: Rebase | None = None) -> dict:
        """Write tables and commit them as a version. Those in append are added to what the current version has of them;
        others take its place. rebase makes further tables out of the current version's, anew where it has changed."""
        self._known(tables)
        folder = self.new_folder()
        for name, df in tables.items():
            df.write.parquet(self.folder(name, folder))
        return self.commit(folder, {name: df.schema for name, df in tables.items()}, dim, append, rebase)

    def _known(self, tables) -> None:
        if unknown := set(tables) - set(TABLES):
            raise ValueError(f"no such tables: {sorted(unknown)}")

    def commit(self, folder: str, schemas: dict[str, T.StructType], dim: int, append: tuple[str, ...] = (), rebase: Rebase | None = None) -> dict:
        """Make tables that were written to a folder part of a new version. A folder that is in the current version is
        not added again, so a commit can be repeated after a break."""
        count, span = 0, 0
        if "chunk" in schemas:
            count, last = self._read("chunk", [folder], schemas["chunk"]).agg(F.count("*"), F.max("chunk_id")).first()
            span = 0 if last is None else last + 1
        for attempt in range(TRIES):
            now = self.manifest()
            old, offsets, known = (json.loads(now.get(k, "{}")) for k in ("folders", "offsets", "schemas"))
            if any(folder in f for f in old.values()):
                return now
            if append and dim and now.get("embedding_dim") and now["embedding_dim"] != dim:
                raise ValueError(f"vectors of {dim} components don't join those of {now['embedding_dim']}")
            joins = "chunk" in append
            folders = {name: [*(old.get(name, []) if name in append else []), folder] for name in schemas}
            kinds = {name: s.json() for name, s in schemas.items()}
            if rebase is not None:
                made = rebase(self._tables(old, offsets, known))
                self._known(made)
                for name, df in made.items():
                    df.write.mode("overwrite").parquet(self.folder(name, f"{folder}-{attempt}"))
                    folders[name], kinds[name] = [f"{folder}-{attempt}"], df.schema.json()
            used = {f for fs in folders.values() for f in fs}
            offsets = {f: o for f, o in offsets.items() if f in used} | {folder: now.get("next_id", 0) if joins else 0}
            row = {
                "version": VERSION, "similarity": SIMILARITY, "embedding_dim": dim or (now.get("embedding_dim", 0) if append else 0), "chunk_count": count + (now.get("chunk_count", 0) if joins else 0),
                "next_id": span + (now.get("next_id", 0) if joins else 0), "folders": json.dumps(folders), "offsets": json.dumps(offsets), "schemas": json.dumps(kinds), "number": now.get("number", 0) + 1, "written": time.time(),
            }
            if create_if_absent(self.spark, self._version_path(row["number"]), json.dumps(row)):
                return row
        raise TimeoutError(f"other writers were first {TRIES} times")

    def reset(self) -> dict:
        """A version that starts empty: what was there stays for readers of versions before, and isn't in this one."""
        return self.commit(self.new_folder(), {}, 0)

    def folders(self) -> dict[str, list[str]]:
        """The folders of the current version's tables."""
        return json.loads(self.manifest()["folders"])

    def _read(self, table: str, folders: list[str], schema: T.StructType, offsets: dict[str, int] | None = None) -> DataFrame:
        df = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[self.folder(table, f) for f in folders])
        moved = {f: o for f, o in (offsets or {}).items() if o and f in folders}
        counts = [c for c in PLACES if c in schema.names]
        if counts and moved:
            # a row a commit, as many as the manifest lists
            added = self.spark.createDataFrame(list(moved.items()), "append string, added long")
            df = df.withColumn("append", F.regexp_extract("_metadata.file_path", "/append=([^/]+)/", 1)).join(F.broadcast(added), "append", "left")
            df = df.withColumns({c: F.col(c) + F.coalesce("added", F.lit(0)) for c in counts})
        return df.select(*schema.names)

    def _tables(self, folders: dict, offsets: dict, schemas: dict) -> dict[str, DataFrame]:
        return {t: self._read(t, f, T.StructType.fromJson(json.loads(schemas[t])), offsets) for t, f in folders.items()}

    def load(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, by default the last. Fails on an older format or another similarity."""
        m = self.manifest(number)
        if not m:
            raise FileNotFoundError(f"no manifest in {self.path}")
        if m["version"] < VERSION or m["similarity"] != SIMILARITY:
            raise ValueError(f"a store of version {m['version']}, similarity {m['similarity']}")
        return self._tables(*(json.loads(m[k]) for k in ("folders", "offsets", "schemas")))

    def clear(self) -> None:
        """Forget all versions; their folders go with the manifest."""
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def verify(self) -> dict:
        """Counts of vectors and chunks, and whether they and the manifest agree."""
        tables = self.load()
        vectors, chunks = (tables[t].count() if t in tables else 0 for t in ("vector", "chunk"))
        ok = vectors == chunks == self.manifest()["chunk_count"]
        return {"total_vectors": vectors, "total_documents": chunks, "index_healthy": ok, "warning": None if ok else "counts differ: build the index again"}

    def export(self, target: str) -> str:
        """The current version as a zip file. The store may be in any file system that Spark reads; its files pass
        through the driver one block at a time."""
        current = {f"{table}/append={f}" for table, folders in self.folders().items() for f in folders}
        last = self._version_path(self.versions()[-1]).rsplit("/", 2)[-1]
        fs, root = self._fs(self.path)
        top = fs.resolvePath(root).toUri().getPath().rstrip("/")
        found = fs.listFiles(root, True)
        files = {}
        while found.hasNext():
            p = found.next().getPath()
            name = p.toUri().getPath()[len(top) + 1 :]
            if (name == f"manifest/{last}" or "/".join(name.split("/")[:2]) in current) and not name.endswith((".tmp", ".crc")):
                files[name] = p
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for name in sorted(files):
                source = fs.open(files[name])
                with z.open(name, "w", force_zip64=True) as out:
                    while block := bytes(source.readNBytes(BLOCK)):
                        out.write(block)
                source.close()
        return target

    @classmethod
    def from_zip(cls, spark: SparkSession, archive: str, path: str) -> Store:
        """Unpack an exported store. Only Parquet and JSON are read afterwards; names that lead outside are refused."""
        store = cls(spark, path)
        with zipfile.ZipFile(archive) as z:
            for info in z.infolist():
                if info.filename.startswith("/") or ".." in info.filename.split("/"):
                    raise ValueError(f"unsafe name in archive: {info.filename}")
            for info in z.infolist():
                if not info.is_dir():
                    fs, p = store._fs(f"{store.path}/{info.filename}")
                    out = fs.create(p, True)
                    with z.open(info) as source:
                        while block := source.read(BLOCK):
                            out.write(block)
                    out.close()
        return store

    def save_progress(self, completed_files: list[str], current_file: str | None, completed_chunks: int, total_vectors: int) -> None:
        row = {"completed_files": completed_files, "current_file": current_file, "completed_chunks_in_file": completed_chunks, "total_vectors_at_save": total_vectors, "saved_at": time.time()}
        self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/progress")

    def load_progress(self) -> dict:
        if not self.exists("progress"):
            return {}
        rows = self.spark.read.json(f"{self.path}/progress").orderBy(F.desc("saved_at")).limit(1).collect()
        return rows[0].asDict() if rows else {}

    def clear_progress(self) -> None:
        fs, p = self._fs(f"{self.path}/progress")
        fs.delete(p, True)
