"""Finding, reading and admitting files."""

from __future__ import annotations

import os
import pickle
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import text
from loamdex.session import ship
from loamdex.sources.config import CONFIG_NAME, STATE_DIR, Config

REJECTED = ("TOO_LARGE", "INVALID_UTF8", "BINARY_CONTENT", "UNSUPPORTED_TYPE")
FAILED = ("READ_FAILED", "FILE_CHANGED", "NOT_REGULAR_FILE")


@dataclass(frozen=True)
class IgnoreRules:
    """The rules of one ignore file, over paths below its folder."""

    rules: tuple[tuple[re.Pattern, bool, bool], ...]

    @staticmethod
    def parse(body: str) -> IgnoreRules:
        out = []
        for line in body.splitlines():
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            glob = line[1:] if keep else line.removeprefix("\\")
            only_dirs, glob = glob.endswith("/"), glob.rstrip("/")
            anchored, glob = "/" in glob, glob.lstrip("/")
            if glob:
                out.append((re.compile(("" if anchored else "(?:.*/)?") + _ignore_regex(glob) + r"\Z"), keep, only_dirs))
        return IgnoreRules(tuple(out))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept, None: no rule speaks of it. The last matching rule decides."""
        for pattern, keep, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.match(path):
                return not keep
        return None


def _ignore_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : j].replace("\\", "\\\\").replace("!", "^", 1 if glob[i + 1] == "!" else 0) + "]", j + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


@dataclass
class Scan:
    """Found files (relative, sorted) and what could not be looked at."""

    files: list[str] = field(default_factory=list)
    issues: list[tuple[str, str]] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return not self.issues


def _issue(e: OSError) -> str:
    return "PERMISSION_DENIED" if isinstance(e, PermissionError) else "NOT_FOUND" if isinstance(e, FileNotFoundError) else "IO_ERROR"


class _Tree:
    """What the settings and ignore files below one root say of paths."""

    def __init__(self, root: str, config: Config):
        self.root, self.issues = root, []
        self.wanted, self.unwanted = (re.compile(text.globs_regex(list(g))) if g else None for g in (config.include, config.exclude))
        pruned = [g[:-3] for g in config.exclude if g.endswith("/**")]
        self.cut = re.compile(text.globs_regex(pruned)) if pruned else None

    def relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/") if path != self.root else ""

    def rules_of(self, folder: str) -> IgnoreRules | None:
        path = os.path.join(folder, ".gitignore")
        if not os.path.lexists(path):
            return IgnoreRules(())
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return IgnoreRules.parse(f.read())
        except OSError as e:
            self.issues.append((self.relative(path), _issue(e)))
            return None

    def ignored(self, stack: list[tuple[str, IgnoreRules]], path: str, is_dir: bool) -> bool:
        for base, rules in reversed(stack):
            said = rules.decide(path[len(base) + 1 :] if base else path, is_dir)
            if said is not None:
                return said
        return False

    def skipped(self, path: str, stack: list) -> bool:
        name = path.rsplit("/", 1)[-1]
        return name in (".git", STATE_DIR) or bool(self.cut and self.cut.match(path.lower())) or self.ignored(stack, path, True)

    def admits(self, path: str) -> bool:
        low = path.lower()
        return (not self.wanted or bool(self.wanted.match(low))) and not (self.unwanted and self.unwanted.match(low))


def is_config(path: str) -> bool:
    return path.rsplit("/", 1)[-1] == CONFIG_NAME


def _walk(tree: _Tree, folder: str, stack: list[tuple[str, IgnoreRules]], deep: bool = True) -> Iterator[str]:
    """The admitted files of a folder and, with ``deep``, of all below it. ``stack`` holds the ignore rules of the folders above."""
    pending = [(folder, stack)]
    while pending:
        here, above = pending.pop()
        rules = tree.rules_of(here)
        if rules is None:
            continue
        inside = [*above, (tree.relative(here), rules)]
        try:
            entries = list(os.scandir(here))
        except OSError as e:
            tree.issues.append((tree.relative(here), _issue(e)))
            continue
        for e in entries:
            path = tree.relative(e.path)
            if e.is_dir(follow_symlinks=False):
                if deep and not tree.skipped(path, inside):
                    pending.append((e.path, inside))
            elif e.is_file(follow_symlinks=False) and not is_config(path) and not tree.ignored(inside, path, False) and tree.admits(path):
                yield path


def _start(tree: _Tree, target: str) -> tuple[str, list[tuple[str, IgnoreRules]]] | None:
    """The folder to begin at and the ignore rules above it; None if the target lies in what is skipped."""
    start = target if os.path.isdir(target) else os.path.dirname(target)
    steps = tree.relative(start).split("/") if start != tree.root else []
    here, stack = tree.root, []
    for k, step in enumerate(steps):
        rules = tree.rules_of(here)
        if rules is None:
            return None
        stack.append((tree.relative(here), rules))
        here = os.path.join(here, step)
        if tree.skipped("/".join(steps[: k + 1]), stack):
            return None
    return start, stack


def scan(root: str, target: str, config: Config, strict: bool = False) -> Scan:
    """Regular files below ``target`` that the settings and ignore files admit. Symbolic links are never followed; whole excluded and ignored folders are skipped; an ignore file that can't be read skips its folder. ``strict``: any issue is an error."""
    tree = _Tree(root, config)
    out, begin, single = Scan(issues=tree.issues), _start(tree, target), None if os.path.isdir(target) else tree.relative(target)
    if begin:
        out.files = sorted(f for f in _walk(tree, *begin, deep=single is None) if single in (None, f))
    if strict and out.issues:
        raise OSError(f"{out.issues[0][0]}: {out.issues[0][1]}")
    return out


#: Folders among which a scan is divided, at least, if there are as many.
FOLDERS = 256


def scan_frame(spark: SparkSession, root: str, target: str, config: Config) -> DataFrame:
    """source_path, issue: what ``scan`` finds, a row for each file (without issue) and for each path that could not be looked at. The driver only looks for enough folders to divide the work; files are listed where the tasks run and never pass the driver."""
    ship(spark)
    tree, schema = _Tree(root, config), "source_path string, issue string"
    begin, single = _start(tree, target), None if os.path.isdir(target) else tree.relative(target)
    if not begin:
        return spark.createDataFrame(tree.issues, schema)
    folders: list[tuple[str, bytes, bool]] = []
    frontier = [begin]
    while single is None and frontier and len(frontier) < FOLDERS:
        below = []
        for here, above in frontier:
            folders.append((here, pickle.dumps(above), False))
            rules = tree.rules_of(here)
            try:
                inside = [*above, (tree.relative(here), rules)]
                below += [(e.path, inside) for e in os.scandir(here) if rules is not None and e.is_dir(follow_symlinks=False) and not tree.skipped(tree.relative(e.path), inside)]
            except OSError:
                pass  # the task that lists the folder reports it
        frontier = below
    folders += [(here, pickle.dumps(above), single is None) for here, above in frontier]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                mine = _Tree(root, config)
                paths = _walk(mine, r.folder, pickle.loads(r.above), r.deep)
                while part := list(islice(paths, 10_000)):
                    kept = [p for p in part if single in (None, p)]
                    yield pd.DataFrame({"source_path": kept, "issue": [None] * len(kept)})
                yield pd.DataFrame(mine.issues, columns=["source_path", "issue"])

    tasks = spark.createDataFrame(folders, "folder string, above binary, deep boolean")
    return tasks.repartition(min(len(folders), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)


class Vanished:
    """Tells which stored paths are gone from below a target, as opposed to being excluded, ignored or replaced by something else. Listings are kept as long as the object."""

    def __init__(self, root: str, target: str, config: Config):
        self.tree, self.root, self.scope = _Tree(root, config), root, os.path.relpath(target, root).replace(os.sep, "/") if target != root else ""
        self.names: dict[str, set[str]] = {}
        self.rules: dict[str, IgnoreRules | None] = {}

    def _spelled(self, path: str) -> os.stat_result | None:
        """The attributes of a path if an entry of exactly that spelling is there; the target and what lies above it keep the spelling they were called by."""
        full = os.path.join(self.root, path)
        try:
            found = os.lstat(full)
        except (FileNotFoundError, NotADirectoryError):
            return None
        if not (self.scope + "/").startswith(path + "/"):
            folder = os.path.dirname(full)
            if folder not in self.names:
                self.names[folder] = set(os.listdir(folder))
            if os.path.basename(full) not in self.names[folder]:
                return None
        return found

    def in_scope(self, path: str) -> bool:
        """Below the target, or below a folder of another spelling that is the same one."""
        if not self.scope:
            return True
        if path == self.scope:
            return False  # a target that is a file by itself was looked at by the scan
        if path.startswith(self.scope + "/"):
            return True
        steps, depth = path.split("/"), self.scope.count("/") + 1
        if len(steps) <= depth:
            return False
        here = self.root
        try:
            for s in steps[:depth]:
                here = os.path.join(here, s)
                if not stat.S_ISDIR(os.lstat(here).st_mode):
                    return False
            return os.path.samefile(here, os.path.join(self.root, self.scope))
        except OSError:
            return False

    def __call__(self, path: str) -> bool:
        """A settings file never counts as stored content, so it goes in any case."""
        if not self.in_scope(path):
            return False
        if is_config(path):
            return True
        if not self.tree.admits(path):
            return False
        steps, stack, gone = path.split("/"), [], False
        for k in range(len(steps)):
            folder = "/".join(steps[:k])
            if folder and self.tree.skipped(folder, stack):
                return False
            if folder and not gone:
                found = self._spelled(folder)
                if found is None:
                    if (self.scope + "/").startswith(folder + "/"):
                        raise FileNotFoundError(folder)
                    gone = True
                elif not stat.S_ISDIR(found.st_mode):
                    return False
            if not gone:
                if folder not in self.rules:
                    self.rules[folder] = self.tree.rules_of(os.path.join(self.root, folder))
                if self.rules[folder] is None:
                    return False
                stack.append((folder, self.rules[folder]))
        if self.tree.ignored(stack, path, False):
            return False
        return gone or self._spelled(path) is None


def vanished(candidates: DataFrame, root: str, target: str, config: Config) -> DataFrame:
    """The rows of stored files (source_path, ...) that are really gone, looked up where the tasks run; what is excluded, ignored, or now a folder or link stays."""
    ship(candidates.sparkSession)
    schema = candidates.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = Vanished(root, target, config)
        for b in batches:
            yield b.filter(pa.array([gone(p) for p in b.column("source_path").to_pylist()], pa.bool_()))

    return candidates.mapInArrow(run, schema)


def read_one(path: str, most: int) -> tuple[bytes | None, int, str | None]:
    """(bytes, size, problem) of a file; read again once if it changed meanwhile."""
    for _ in range(2):
        try:
            before = os.lstat(path)
            if not stat.S_ISREG(before.st_mode):
                return None, 0, "NOT_REGULAR_FILE"
            if before.st_size > most:
                return None, before.st_size, "TOO_LARGE"
            with open(path, "rb") as f:
                body = f.read(most + 1)
            after = os.lstat(path)
        except OSError:
            return None, 0, "READ_FAILED"
        if (before.st_size, before.st_mtime_ns, before.st_ino) == (after.st_size, after.st_mtime_ns, after.st_ino) and len(body) == after.st_size:
            return body, len(body), None
    return None, 0, "FILE_CHANGED"


def load(spark: SparkSession, root: str, files: list[str] | DataFrame, most: int) -> DataFrame:
    """source_path, content (binary), byte_size, problem of files (a list, or a table with source_path) that every executor sees below ``root``; read where the tasks run."""

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 64):
                part = b.iloc[at : at + 64]
                rows = [(p, *read_one(os.path.join(root, p), most)) for p in part["source_path"]]
                yield pd.DataFrame(rows, columns=["source_path", "content", "byte_size", "problem"])

    paths = files.select("source_path") if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], "source_path string")
    return paths.repartition(4 * spark.sparkContext.defaultParallelism, "source_path").mapInPandas(run, "source_path string, content binary, byte_size long, problem string")


def stored_files(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """The same columns from any storage that Spark reads (object stores and the like), by its file source; the settings' patterns are applied to the paths. That source doesn't list files of no bytes, which have no chunks."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace(F.col("path"), "^(?:[a-z0-9]+:)?/*" + re.escape(re.sub(r"^[a-z0-9]+:/*", "", base).lstrip("/")) + "/", "")
    small = F.col("length") <= config.max_file_bytes
    return raw.select(path.alias("source_path"), F.when(small, F.col("content")).alias("content"), F.col("length").alias("byte_size"), F.when(~small, "TOO_LARGE").alias("problem")).filter(text.admitted(F.col("source_path"), list(config.include), list(config.exclude)))


def admit(loaded: DataFrame) -> DataFrame:
    """source_path, document_type, content (text), content_hash, byte_size, problem: strict UTF-8 without BOM, not binary. A file with a problem has no content."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    body = text.strip_bom(F.col("content").cast("string"))
    problem = F.coalesce("problem", F.when(~valid, "INVALID_UTF8").when(text.looks_binary(body), "BINARY_CONTENT"))
    out = loaded.select("source_path", text.document_type(F.col("source_path")).alias("document_type"), body.alias("_body"), F.sha2("content", 256).alias("content_hash"), "byte_size", problem.alias("problem"))
    return out.select("source_path", "document_type", F.when(F.col("problem").isNull(), F.col("_body")).alias("content"), "content_hash", "byte_size", "problem")
