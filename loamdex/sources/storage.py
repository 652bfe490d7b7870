"""Small files and versioned table folders on any file system that Spark reads."""

from __future__ import annotations

import errno
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Version of the layout below; an index of another version is refused, one of the version before is migrated.
FORMAT = 2
#: Pointer files are numbered and never replaced; the highest number holds.
POINTER = "CURRENT-"
#: Buckets of a new index: what one changed file has rewritten is one bucket. Kept with the index.
BUCKETS = 64


class Folder:
    """Small text files of a folder; a written file appears whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path("")))

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file by rename, which is one step on a file system; a name that is taken is refused, so no file is ever without its content. What changes gets a new name each time: see ``latest``."""
        part = f"_{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            raise FileExistsError(f"{self.path}/{name} could not be written")

    def latest(self, prefix: str) -> str | None:
        """The content of the file with the highest number behind ``prefix``; None if there is none."""
        names = [n for n in self.names() if n.startswith(prefix) and n[len(prefix) :].isdigit()]
        return self.read(max(names, key=lambda n: int(n[len(prefix) :]))) if names else None

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class IndexAccessError(Exception):
    """Why an index can't be opened: NOT_FOUND, INCOMPATIBLE, MIGRATION_REQUIRED, WRONG_PROJECT or CORRUPT_INDEX."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


class StorageFailure(Exception):
    """Why an index could not be read or written: DISK_FULL, BUSY, READ_ONLY, IO_ERROR, CORRUPT, WRONG_PROJECT, INCOMPATIBLE or OTHER."""

    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


# What each class of failure is recognised by, in the exceptions of file systems and of Spark; the first that fits counts.
_SIGNS = {
    "DISK_FULL": r"No space left|DiskOutOfSpace|DSQuotaExceeded|Disk quota exceeded|not enough space",
    "READ_ONLY": r"Read-only file system|AccessControlException|AccessDenied|Permission denied|Mkdirs failed",
    "CORRUPT": r"is not a Parquet file|ParquetDecodingException|FAILED_READ_FILE|CANNOT_READ_FILE_FOOTER|ChecksumException|corrupt|FileNotFoundException|FILE_NOT_EXIST|PATH_NOT_FOUND",
    "BUSY": r"lease|AlreadyBeingCreated|ConcurrentModification",
    "IO_ERROR": r"IOException|SocketTimeout|Input/output error",
}
_ACCESS = {"CORRUPT_INDEX": "CORRUPT", "WRONG_PROJECT": "WRONG_PROJECT", "INCOMPATIBLE": "INCOMPATIBLE", "MIGRATION_REQUIRED": "INCOMPATIBLE", "NOT_FOUND": "OTHER"}


def storage_failure(e: Exception) -> str:
    """The class of a failure of the storage, by its type and by what it and its causes say."""
    if isinstance(e, StorageFailure):
        return e.reason
    if isinstance(e, IndexAccessError):
        return _ACCESS[e.reason]
    if isinstance(e, FileExistsError):
        return "BUSY"
    if isinstance(e, OSError) and e.errno in (errno.ENOSPC, errno.EDQUOT):
        return "DISK_FULL"
    if isinstance(e, PermissionError) or isinstance(e, OSError) and e.errno == errno.EROFS:
        return "READ_ONLY"
    said, seen = "", e
    while seen is not None:
        said += f"{type(seen).__name__} {seen} "
        seen = seen.__cause__
    for reason, sign in _SIGNS.items():
        if re.search(sign, said, re.I):
            return reason
    return "IO_ERROR" if isinstance(e, OSError) else "OTHER"


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables: for each table its schema and, for each bucket of files, the version that wrote it. A reader that holds it sees nothing of later runs."""

    spark: SparkSession
    path: str
    number: int
    schemas: dict[str, str] = field(repr=False)
    buckets: dict[str, dict[str, int]] = field(repr=False)
    #: For each bucket its chunks and their tokens.
    stats: dict[str, list[int]] = field(repr=False)

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some buckets of it."""
        schema = T.StructType.fromJson(json.loads(self.schemas[name]))
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.path}/v{v:06d}/{name}/bucket={b}" for b, v in self.buckets[name].items() if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def totals(self) -> tuple[int, int]:
        """(chunks, tokens) of the whole index, without reading it."""
        return sum(n for n, _ in self.stats.values()), sum(t for _, t in self.stats.values())


class SnapshotStore:
    """Versioned tables below a folder, split into buckets by the hash of a file's path.

    A run writes the buckets it touches under a new version and then one new pointer file that names the version of every bucket, so it takes effect as a whole or not at all, and what it writes is proportional to what it touches. What the last ``keep`` pointers don't name is removed.
    """

    def __init__(self, spark: SparkSession, path: str, project: str, keep: int = 8, buckets: int = BUCKETS):
        self.spark, self.path, self.project, self.keep, self.buckets = spark, path.rstrip("/"), project, keep, buckets
        self.folder = Folder(spark, self.path)

    def create(self, derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] = lambda tables: tables) -> None:
        """Makes the index if there is none and migrates one of the format before; refuses another project's or an unknown format's. ``derive`` gives the tables to store from those that a migration carries over."""
        if self._meta() is None:
            self.folder.write("meta-000001", json.dumps({"project": self.project, "format": FORMAT, "buckets": self.buckets}))
        try:
            self._check()
        except IndexAccessError as e:
            if e.reason != "MIGRATION_REQUIRED":
                raise
            self._migrate(derive)

    def _meta(self) -> str | None:
        return self.folder.latest("meta-") or (self.folder.read("meta.json") if self.folder.exists("meta.json") else None)

    def _check(self) -> None:
        text = self._meta()
        if text is None:
            raise IndexAccessError("NOT_FOUND", f"there is no index at {self.path}")
        try:
            meta = json.loads(text)
            kind, project = meta["format"], meta["project"]
            self.buckets = meta.get("buckets", self.buckets)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise IndexAccessError("CORRUPT_INDEX", f"the index at {self.path} can't be read: {e}") from e
        if project != self.project:
            raise IndexAccessError("WRONG_PROJECT", f"the index belongs to {project}")
        if kind == FORMAT - 1:
            raise IndexAccessError("MIGRATION_REQUIRED", f"the index has format {kind}; the next indexing run brings it to {FORMAT}")
        if kind != FORMAT:
            raise IndexAccessError("INCOMPATIBLE", f"the index has format {kind}, this version reads {FORMAT}")

    def _migrate(self, derive: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        """From format 1: a folder for each table of a version, and one pointer file. Its tables are split into buckets under the next number; until the new pointer and then the new format are written the old index is untouched, so a migration that dies is done again."""
        number = int(self.folder.read("CURRENT")) if self.folder.exists("CURRENT") else 0
        if number and self.folder.latest(POINTER) is None:
            folder = f"{self.path}/v{number:06d}"
            tables = {n: self.spark.read.parquet(f"{folder}/{n}") for n in Folder(self.spark, folder).names()}
            self._write(derive(tables), number + 1)
        self.folder.write("meta-000002", json.dumps({"project": self.project, "format": FORMAT, "buckets": self.buckets}))
        self._check()
        for n in self.folder.names():
            if n in ("CURRENT", "meta.json") or n[:1] == "v" and n[1:].isdigit() and int(n[1:]) <= number:
                self.folder.remove(n)

    def current(self) -> Snapshot | None:
        """The version that holds now; None before the first."""
        self._check()
        try:
            text = self.folder.latest(POINTER)
            if text is None:
                return None
            p = json.loads(text)
            snapshot = Snapshot(self.spark, self.path, p["number"], p["schemas"], p["buckets"], p["stats"])
        except (ValueError, KeyError, TypeError) as e:
            raise IndexAccessError("CORRUPT_INDEX", f"the pointer of {self.path} can't be read") from e
        if missing := [v for v in {v for b in snapshot.buckets.values() for v in b.values()} if not self.folder.exists(f"v{v:06d}")]:
            raise IndexAccessError("CORRUPT_INDEX", f"version {missing[0]} of {self.path} is missing")
        return snapshot

    def bucket(self, columns: list[str]) -> Column:
        """The bucket of a row, by its file's id (which is the hash of the path) or path."""
        file = F.col("file_id") if "file_id" in columns else F.xxhash64("source_path") if "source_path" in columns else F.lit(0)
        return F.pmod(file, F.lit(self.buckets)).cast("int")

    def commit(self, tables: dict[str, DataFrame], touched: dict[str, list[int]] | None = None, base: Snapshot | None = None) -> Snapshot:
        """Writes the rows of the ``touched`` buckets of each table (default: all) as the next version and makes it current; other buckets and tables stay as they are. What a dead run left behind is overwritten.

        ``base`` is the version the run began with: if another one holds by now, the run fails as BUSY.
        """
        old = self.current()
        if base is not None and (old is None or old.number != base.number):
            raise StorageFailure("BUSY", f"another run changed {self.path} meanwhile")
        snapshot = self._write(tables, old.number + 1 if old else 1, old, touched)
        self._tidy(snapshot.number)
        return snapshot

    def _write(self, tables: dict[str, DataFrame], number: int, old: Snapshot | None = None, touched: dict[str, list[int]] | None = None) -> Snapshot:
        """Rows go to the bucket of their file, split over tasks by measured size and sorted by ``term`` where they have one, so that a search reads few of them. A table with ``n_tokens`` of each chunk is counted by bucket."""

        def rest(entries: dict, table: str) -> dict:
            return {} if touched is None else {b: x for b, x in entries.items() if int(b) not in set(touched[table])}

        schemas, buckets, stats = dict(old.schemas if old else {}), dict(old.buckets if old else {}), old.stats if old else {}
        for name, df in tables.items():
            schemas[name], path = df.schema.json(), f"{self.path}/v{number:06d}/{name}"
            rows = df.withColumn("bucket", self.bucket(df.columns))
            order = [c for c in ("term", "chunk_id") if "term" in df.columns]
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(path)
            written = {n[7:]: number for n in Folder(self.spark, path).names() if n.startswith("bucket=")}
            buckets[name] = rest(buckets.get(name, {}), name) | written
            if "n_tokens" in df.columns and not order:
                sums = self.spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect() if written else []
                stats = rest(stats, name) | {str(r.bucket): [r.n, r.t] for r in sums}
        try:
            self.folder.write(f"{POINTER}{number:06d}", json.dumps({"number": number, "schemas": schemas, "buckets": buckets, "stats": stats}))
        except FileExistsError as e:
            raise StorageFailure("BUSY", f"another run wrote version {number} of {self.path}") from e
        return Snapshot(self.spark, self.path, number, schemas, buckets, stats)

    def _tidy(self, number: int) -> None:
        """Removes old pointers, then every bucket that no pointer left names."""
        for n in self.folder.names():
            if n.startswith(POINTER) and n[len(POINTER) :].isdigit() and int(n[len(POINTER) :]) <= number - self.keep:
                self.folder.remove(n)
        used: set[tuple[str, str, str]] = set()
        for n in self.folder.names():
            if n.startswith(POINTER) and n[len(POINTER) :].isdigit():
                used |= {(f"v{v:06d}", table, f"bucket={b}") for table, bs in json.loads(self.folder.read(n))["buckets"].items() for b, v in bs.items()}
        for version in [n for n in self.folder.names() if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) <= number - self.keep]:
            if version not in {v for v, _, _ in used}:
                self.folder.remove(version)
                continue
            for table in Folder(self.spark, f"{self.path}/{version}").names():
                folder = Folder(self.spark, f"{self.path}/{version}/{table}")
                for b in folder.names():
                    if b.startswith("bucket=") and (version, table, b) not in used:
                        folder.remove(b)
