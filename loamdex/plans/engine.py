"""The library's front: building an index and asking it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.functions import scoring, text
from loamdex.functions.counters import BasicCounter
from loamdex.functions.progress import progress_text
from loamdex.operators import chunking, hybrid, incremental, lexical, semantic, snippets
from loamdex.session import materialise, ship
from loamdex.sources import files as source
from loamdex.sources.config import CONFIG_NAME, Config
from loamdex.sources.storage import BUCKETS, IndexAccessError, Snapshot, SnapshotStore, StorageFailure, storage_failure

Model = Callable[[list[str]], np.ndarray]
#: Problems that a result shows (``Engine.problems`` has all), chunks of a page of embeddings, and pages that may fail in a row.
SHOWN, PAGE, FAILING = 1000, 1_000_000, 3
FILES = "source_path string, document_type string, content_hash string, byte_size long, chunking_fingerprint string"
CHUNKS = "id long, file_id long, chunk_index int, content string, start_line int, end_line int, heading_path array<string>, attributes map<string,string>, source_path string, document_type string, stable_id string"
VECTORS = "chunk_id long, source_path string, fingerprint string, vector array<float>"


class QueryError(ValueError):
    """Why a query can't be answered: an input problem (BLANK, NUL, TOO_LONG, LIMIT, TOO_MANY_PARTS) or a missing prerequisite (EMBEDDINGS_MISSING, EMBEDDINGS_OUTDATED, then MODEL_MISSING, EMBEDDING_FAILED)."""

    def __init__(self, reason: str, message: str = ""):
        super().__init__(message or reason)
        self.reason = reason


class Cancelled(Exception):
    """The run was cancelled; nothing of it took effect."""


@dataclass
class IndexResult:
    """``issues`` shows at most SHOWN problem paths and SHOWN failed embeddings; the counts are exact and ``Engine.problems`` has all of them."""

    status: str
    counts: dict[str, int] = field(default_factory=dict)
    chunks: int = 0
    embedded: int = 0
    rejected: int = 0
    failed: int = 0
    failed_embeddings: int = 0
    issue_count: int = 0
    deleted: int = 0
    discarded_vectors: int = 0
    issues: list[tuple[str, str]] = field(default_factory=list)
    timings_ms: dict[str, int] = field(default_factory=dict)
    version: int | None = None
    #: Why the embedding ended before all chunks were tried (INVALID_MODEL, INFERENCE_FAILED); None if it did not.
    stopped: str | None = None


@dataclass
class QueryResult:
    hits: list[dict]
    requested_mode: str
    effective_mode: str
    fallback: dict | None = None
    coverage: dict | None = None
    query_shape: str | None = None
    notices: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class Engine:
    """An index of one project.

    ``model`` maps texts to rows of numbers and is needed only for the semantic side; ``profile`` says what made its vectors. ``counter`` counts tokens for chunk budgets. ``buckets`` is how many parts a new index is split into by files.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, counter=None, model: Model | None = None, profile: text.EmbeddingProfile | None = None, store: str | None = None, overrides: dict | None = None, buckets: int = BUCKETS):
        ship(spark)
        self.spark, self.root, self.config = spark, root, config or Config()
        self.counter, self.model, self.profile, self.overrides = counter or BasicCounter(), model, profile, overrides
        c = self.counter
        self.identity = text.ChunkingIdentity(c.algorithm, c.vocabulary_sha256, c.vocabulary_size, c.max_input_tokens, c.special_tokens, self.config.max_tokens, self.config.overlap_tokens)
        self.store = SnapshotStore(spark, store or f"{root}/{self.config.store}", root, buckets=buckets)
        self.cancelled = False
        #: kind (file or embedding), source_path, chunk_id, problem of every file and embedding that failed in the last run; None before the first.
        self.problems: DataFrame | None = None

    # Building

    def cancel(self) -> None:
        """Stops the run at its next step; what is stored stays as it was."""
        self.cancelled = True
        self.spark.sparkContext.cancelAllJobs()

    def _step(self, name: str, result: IndexResult, began: float, progress: Callable[[str, int], None] | None) -> float:
        if self.cancelled:
            raise Cancelled
        now = time.monotonic()
        result.timings_ms[name] = int(1000 * (now - began))
        if progress:
            progress(name, result.timings_ms[name])
        return now

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _plan(self, target: str | None) -> tuple[list[tuple[str, str]], int, DataFrame, Snapshot | None, DataFrame, DataFrame]:
        """(issues of the scan as far as shown, their number, files found, current version, files stored, decisions)."""
        scanned = materialise(source.scan_frame(self.spark, self.root, (target or self.root).rstrip("/"), self.config), "scanned")
        issues = scanned.filter("issue is not null")
        shown = [(r.source_path, r.issue) for r in issues.orderBy("source_path").limit(SHOWN).collect()]
        found = materialise(source.admit(source.load(self.spark, self.root, scanned.filter("issue is null"), self.config.max_file_bytes)), "found")
        snapshot = self.store.current()
        stored = snapshot.table("files") if snapshot else self._empty(FILES)
        fine = found.filter("problem is null")
        return shown, issues.count() if len(shown) == SHOWN else len(shown), found, snapshot, stored, incremental.decisions(fine, stored, self.identity.fingerprint())

    def _gone(self, target: str | None, stored: DataFrame, seen: DataFrame, bad: int, issues: int) -> DataFrame:
        """The stored files below the target that are really gone."""
        path = F.col("source_path")
        wanted = text.admitted(path, list(self.config.include), list(self.config.exclude)) | (text.file_name(path) == CONFIG_NAME)
        return self._still_gone(target, materialise(incremental.deletions(stored, seen, bad, issues, wanted), "unseen"))

    def _still_gone(self, target: str | None, candidates: DataFrame) -> DataFrame:
        """Those of some stored files that the file system doesn't have now."""
        if candidates.isEmpty():
            return candidates
        return materialise(source.vanished(candidates, self.root, (target or self.root).rstrip("/"), self.config), "gone")

    def preview(self, target: str | None = None) -> dict:
        """What ``index`` would do, without writing: files and chunks by decision, with estimates where chunks aren't known, and deletions."""
        self._open()
        issues, n_issues, found, snapshot, stored, decided = self._plan(target)
        bad = found.filter("problem is not null").count()
        counts = (snapshot.table("chunks") if snapshot else self._empty(CHUNKS)).groupBy("source_path").agg(F.count(F.lit(1)).alias("chunks"))
        totals = incremental.preview_totals(decided, found.select("source_path", "document_type", "byte_size"), counts)
        gone = self._gone(target, stored, found, bad, n_issues)
        return {"decisions": {r.decision: {"files": r.files, "chunks": r.chunks, "estimated": r.estimated} for r in totals.collect()}, "rejected": bad, "deleted": gone.count(), "issues": issues}

    def _open(self) -> None:
        self.store.create(lambda old: {n: old[n] for n in ("files", "chunks", "vectors")} | self._derived(old["chunks"]))

    def _derived(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """Postings and lengths of chunks. Texts are split by chunk once; their tokens are not shuffled before they are grouped."""
        rows = self._rows(chunks).repartition("chunk_id")
        return {"postings": lexical.postings(rows), "lengths": lexical.chunk_lengths(rows, "file_id")}

    def _buckets(self, *frames: DataFrame) -> list[int]:
        """The buckets of the rows' files, at most as many as the index has."""
        found: set[int] = set()
        for df in frames:
            found |= {r.b for r in df.select(self.store.bucket(df.columns).alias("b")).distinct().collect()}
        return sorted(found)

    def index(self, target: str | None = None, progress: Callable[[str, int], None] | None = None) -> IndexResult:
        """Brings the index up to date with the files below ``target``.

        Unchanged files never reach Python again, and buckets without a changed file are neither read nor written; rejected files keep their stored version; vanished ones go only if everything could be scanned and read, and only if they are still gone when the run writes. Files, chunks and postings take effect together; vectors follow page by page. Failures of the storage are ``StorageFailure`` with their class.
        """
        try:
            return self._index(target, progress)
        except (StorageFailure, IndexAccessError):
            raise
        except Exception as e:
            if (reason := storage_failure(e)) != "OTHER":
                raise StorageFailure(reason, str(e)) from e
            raise

    def _index(self, target: str | None, progress: Callable[[str, int], None] | None) -> IndexResult:
        self.cancelled, result, began = False, IndexResult("COMPLETE"), time.monotonic()
        self._open()
        try:
            issues, n_issues, found, old, stored, decided = self._plan(target)
            began = self._step("discover", result, began, progress)
            decided = materialise(decided, "decided")
            result.counts = {r.decision: r.files for r in incremental.run_counters(decided).collect()}
            problems = [(r.source_path, r.problem) for r in found.filter("problem is not null").select("source_path", "problem").orderBy("source_path").limit(SHOWN).collect()]
            numbers = {r.problem: r["count"] for r in found.groupBy("problem").count().collect() if r.problem}
            result.rejected = sum(n for p, n in numbers.items() if p in source.REJECTED)
            result.failed = sum(n for p, n in numbers.items() if p in source.FAILED)
            result.issues = [*issues, *problems]
            result.issue_count = n_issues + sum(numbers.values())
            self.problems = found.filter("problem is not null").select(F.lit("file").alias("kind"), "source_path", F.lit(None).cast("long").alias("chunk_id"), "problem")
            gone = self._gone(target, stored, found, sum(numbers.values()), n_issues)
            began = self._step("decide", result, began, progress)
            changed = found.join(decided.filter("decision <> 'UNCHANGED'").select("source_path"), "source_path", "left_semi")
            work = sum(n for d, n in result.counts.items() if d != "UNCHANGED")
            gone = self._still_gone(target, gone)
            result.deleted = gone.count()
            snapshot = old
            if work or result.deleted or old is None:
                snapshot = self._replace(changed, gone, old)
            result.chunks = snapshot.totals()[0]
            began = self._step("chunk", result, began, progress)
            if self.profile:
                snapshot, result.discarded_vectors = self._discard(snapshot)
            if self.model and self.profile and self.config.semantic:
                snapshot, errors = self._backfill(snapshot, result, progress)
                if errors is not None:
                    self.problems = self.problems.unionByName(errors)
                    result.failed_embeddings = errors.count()
                    result.issue_count += result.failed_embeddings
                    result.issues += [(r.kind, f"{r.source_path}, chunk {r.chunk_id}: {r.problem}") for r in errors.orderBy("source_path", "chunk_id").limit(SHOWN).collect()]
                began = self._step("embed", result, began, progress)
            result.version = snapshot.number
        except Cancelled:
            return IndexResult("CANCELLED", timings_ms=result.timings_ms)
        except Exception:
            if self.cancelled:
                return IndexResult("CANCELLED", timings_ms=result.timings_ms)
            raise
        result.status = "PARTIAL" if result.issues or result.stopped else "COMPLETE"
        return result

    def _replace(self, changed: DataFrame, gone: DataFrame, old: Snapshot | None) -> Snapshot:
        """The next version, in which changed files replace their old rows and vanished ones have none; only the buckets of these files are read and written."""
        fingerprint = self.identity.fingerprint()
        new_files = changed.select("source_path", "document_type", "content_hash", "byte_size", F.lit(fingerprint).alias("chunking_fingerprint"))
        touched = self._buckets(new_files, gone)

        def kept(name: str, schema: str) -> DataFrame:
            return old.table(name, touched) if old and name in old.schemas else self._empty(schema)

        cut = chunking.chunk_documents(changed, self.identity.budget, self.config.overlap_tokens, self.counter, self.overrides)
        ids = {"id": F.xxhash64("source_path", "chunk_index", F.lit(fingerprint)), "file_id": F.xxhash64("source_path"), "stable_id": text.stable_id(F.col("source_path"), F.col("chunk_index"), F.lit(fingerprint))}
        new_chunks = cut.withColumns(ids).select(*[n.split()[0] for n in CHUNKS.split(", ")])
        paths = new_files.select("source_path").union(gone.select("source_path")).distinct()
        files = incremental.replace_files(incremental.checked_removal(kept("files", FILES), gone), new_files, gone)
        chunks = materialise(kept("chunks", CHUNKS).join(paths, "source_path", "left_anti").unionByName(new_chunks), "chunks")
        vectors = kept("vectors", VECTORS).join(paths, "source_path", "left_anti")
        tables = {"files": files, "chunks": chunks, "vectors": vectors} | self._derived(chunks)
        return self.store.commit(tables, {n: touched for n in tables} if old else None, old)

    def _discard(self, snapshot: Snapshot) -> tuple[Snapshot, int]:
        """A version without vectors of other profiles; the number of those it lacks."""
        vectors, mine = snapshot.table("vectors"), F.col("fingerprint") == self.profile.fingerprint()
        lost = vectors.filter(~mine).count()
        return (self.store.commit({"vectors": vectors.filter(mine)}, base=snapshot) if lost else snapshot), lost

    def _rows(self, chunks: DataFrame) -> DataFrame:
        return chunks.select(F.col("id").alias("chunk_id"), "file_id", "chunk_index", "content", F.array_join("heading_path", " ").alias("headings"), "source_path", "start_line", "end_line")

    def _backfill(self, snapshot: Snapshot, result: IndexResult, progress: Callable[[str, int], None] | None) -> tuple[Snapshot, DataFrame | None]:
        """Embeds the chunks without a vector, in pages of whole buckets of about PAGE chunks. Each page is a version of its own, so a run that stops leaves only the rest for the next one.

        A chunk that can't be embedded is reported and skipped. A model that says it is broken, or FAILING pages in a row of which nothing could be embedded, end the embedding; the pages before stand.
        """
        fingerprint, counter, size = self.profile.fingerprint(), self.counter, self.profile.dimensions

        @F.pandas_udf("string")
        def inputs(path, headings, content):
            import pandas as pd

            return pd.Series([chunking.embedding_input(p, list(h), c, counter) for p, h, c in zip(path, headings, content)])

        missing = semantic.unembedded(snapshot.table("chunks").select("id", "file_id"), snapshot.table("vectors"), fingerprint)
        sizes = {r.b: r["count"] for r in missing.groupBy(self.store.bucket(["file_id"]).alias("b")).count().orderBy("b").collect()}
        pages: list[list[int]] = []
        held = PAGE
        for b, n in sizes.items():
            if held >= PAGE:
                pages, held = [*pages, []], 0
            pages[-1].append(b)
            held += n
        failed, tried, errors, began = 0, 0, None, time.monotonic()
        for page in pages:
            if self.cancelled:
                raise Cancelled
            chunks, vectors = snapshot.table("chunks", page), snapshot.table("vectors", page)
            todo = semantic.unembedded(chunks, vectors, fingerprint)
            texts = todo.select("id", "source_path", inputs("source_path", "heading_path", "content").alias("input"))
            try:
                made = materialise(semantic.embed(texts, "input", self.model), "embedded")
            except Exception as e:
                if semantic.BrokenModel.__name__ not in str(e):
                    raise
                result.stopped = "INVALID_MODEL"
                break
            fine = F.coalesce((F.size("vector") == size) & F.forall("vector", lambda x: ~F.isnan(x)), F.lit(False))
            paths = chunks.select("id", "source_path").distinct()
            new = made.filter(fine).join(paths, "id").select(F.col("id").alias("chunk_id"), "source_path", F.lit(fingerprint).alias("fingerprint"), "vector")
            problem = F.coalesce("error", F.lit(f"no vector of {size} numbers")).alias("problem")
            bad = materialise(made.filter(~fine).join(paths, "id").select(F.lit("embedding").alias("kind"), "source_path", F.col("id").alias("chunk_id"), problem), "errors")
            errors = bad if errors is None else errors.unionByName(bad)
            done = made.filter(fine).count()
            if done:
                snapshot = self.store.commit({"vectors": semantic.only_profile(vectors.unionByName(new), fingerprint)}, {"vectors": page}, snapshot)
                result.embedded += done
            failed, tried = 0 if done else failed + 1, tried + sum(sizes[b] for b in page)
            if progress:
                spent = time.monotonic() - began
                progress(progress_text("embedding", tried, sum(sizes.values()), spent, "chunk"), int(1000 * spent))
            if failed == FAILING:
                result.stopped = "INFERENCE_FAILED"
                break
        return snapshot, errors

    # Asking

    def query(self, words: str, limit: int = 10, mode: str | None = None) -> QueryResult:
        """The hits of one query, best first."""
        mode = mode or self.config.mode
        problem = self.spark.range(1).select(text.query_problem(F.lit(words), F.lit(limit)).alias("p"), text.part_count(F.lit(words)).alias("n"), text.query_shape(F.lit(words)).alias("shape"), text.phrases(F.lit(words)).alias("phrases")).first()
        if problem.p:
            raise QueryError(problem.p)
        if mode == "lexical" and problem.n > text.MAX_PARTS:
            raise QueryError("TOO_MANY_PARTS")
        snapshot = self.store.current()
        result = QueryResult([], mode, "lexical" if mode == "auto" else mode, warnings=list(self.config.warnings))
        if snapshot is None or not snapshot.totals()[0]:
            return result
        vector = None
        if mode != "lexical":
            try:
                result.coverage = self._coverage(snapshot)
                vector = self._embed_query(words)
                most = self.profile.max_input_tokens - self.counter.special_tokens
                if self.counter.count(words) > most:
                    result.notices.append("QUERY_CUT_TO_MODEL_INPUT")
                result.effective_mode = "hybrid" if mode == "auto" else mode
            except QueryError as e:
                if mode != "auto":
                    raise
                result.coverage, result.fallback = None, {"reason": e.reason, "message": str(e)}
                if problem.n > text.MAX_PARTS:
                    raise QueryError("TOO_MANY_PARTS") from e
        chunks = snapshot.table("chunks")
        keys = chunks.select(F.col("id").alias("chunk_id"), "source_path", "chunk_index")
        depth = limit if result.effective_mode != "hybrid" else scoring.DEPTH
        lex = sem = None
        asked = self.spark.createDataFrame([(0, words)], "query_id long, text string")
        if result.effective_mode in ("lexical", "hybrid"):
            if problem.n > text.MAX_PARTS:
                result.notices.append("LEXICAL_SIDE_SKIPPED")
            found = lexical.wanted_terms(snapshot.table("postings"), problem.phrases)
            scores = lexical.bm25_scores(found, snapshot.totals(), asked, many=False)
            lex = lexical.top_hits(scores, keys, depth)
        if vector is not None:
            near = snapshot.table("vectors").filter(F.col("fingerprint") == self.profile.fingerprint())
            target = F.array(*[F.lit(float(x)) for x in vector])
            scores = near.select(F.lit(0).cast("long").alias("query_id"), "chunk_id", scoring.cosine(F.col("vector"), target).alias("score")).filter("score is not null")
            sem = lexical.top_hits(scores, keys, depth, best="desc")
        if result.effective_mode == "hybrid":
            result.query_shape = problem.shape
            shaped = self.spark.createDataFrame([(0, problem.shape)], "query_id long, shape string")
            top, kind = hybrid.fuse(lex, sem, shaped, limit), "RECIPROCAL_RANK_FUSION"
        else:
            top, kind = (lex, "SQLITE_BM25") if lex is not None else (sem, "COSINE_SIMILARITY")
        result.hits = self._hits(top, kind, chunks, problem.phrases, result.effective_mode == "semantic")
        return result

    def _coverage(self, snapshot: Snapshot) -> dict:
        fingerprint = self.profile.fingerprint() if self.profile else ""
        row = semantic.coverage(snapshot.table("chunks"), snapshot.table("vectors"), fingerprint).first()
        if not row.embedded:
            raise QueryError("EMBEDDINGS_OUTDATED" if row.stale else "EMBEDDINGS_MISSING")
        return row.asDict()

    def _embed_query(self, words: str) -> np.ndarray:
        if not self.model:
            raise QueryError("MODEL_MISSING", "no model is given")
        try:
            vector = np.asarray(self.model([words])[0], np.float64)
        except Exception as e:
            raise QueryError("EMBEDDING_FAILED", str(e)) from e
        if vector.shape != (self.profile.dimensions,) or not np.isfinite(vector).all() or not vector.any():
            raise QueryError("EMBEDDING_FAILED", "the query's vector has no direction or another length")
        return vector

    def _hits(self, top: DataFrame, kind: str, chunks: DataFrame, phrases: list[list[str]], plain: bool) -> list[dict]:
        """Texts are joined to the few ranked rows only."""
        shown = top.join(chunks.withColumnRenamed("id", "chunk_id").drop("source_path", "chunk_index"), "chunk_id").orderBy("rank").collect()
        out = []
        for r in shown:
            words, ranges = snippets.snippet(r.content, [] if plain else phrases)
            out.append({"rank": r["rank"], "source_path": r.source_path, "document_type": r.document_type, "start_line": r.start_line, "end_line": r.end_line, "chunk_index": r.chunk_index, "stable_id": r.stable_id, "heading_path": list(r.heading_path), "score_kind": kind, "score": r.score, "lexical_rank": r["lexical_rank"] if "lexical_rank" in top.columns else None, "semantic_rank": r["semantic_rank"] if "semantic_rank" in top.columns else None, "snippet": words, "matches": [{"start": a, "end": b} for a, b in ranges]})
        return out

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """Lexical hits (query_id, rank, chunk_id, score, source_path, chunk_index) of a whole table of queries (query_id, text) at once."""
        snapshot = self.store.current()
        if snapshot is None:
            raise IndexAccessError("NOT_FOUND", "nothing is indexed yet")
        keys = snapshot.table("chunks").select(F.col("id").alias("chunk_id"), "source_path", "chunk_index")
        return lexical.top_hits(lexical.bm25_scores(snapshot.table("postings"), snapshot.totals(), queries), keys, limit)


def result_json(result: QueryResult | IndexResult | dict) -> str:
    """The JSON form: schemaVersion first, stable order of fields, ASCII only."""
    body = result if isinstance(result, dict) else asdict(result)
    return json.dumps({"schemaVersion": 1, **body}, ensure_ascii=True, indent=2)


def score_text(score: float) -> str:
    """Three significant digits without an exponent."""
    if score == 0:
        return "0"
    digits = max(0, 2 - int(np.floor(np.log10(abs(score)))))
    return f"{score:.{digits}f}"


def hit_text(hit: dict, marks: tuple[str, str] = ("[", "]")) -> str:
    """A hit for a terminal: place, score, and the snippet with its matches marked."""
    s, shift = hit["snippet"], 0
    for m in hit["matches"]:
        for at, mark in ((m["start"], marks[0]), (m["end"], marks[1])):
            s, shift = s[: at + shift] + mark + s[at + shift :], shift + len(mark)
    lines = "\n".join("   " + x for x in s.splitlines() if x.strip())
    return f"{hit['rank']}. {hit['source_path']}:{hit['start_line']}-{hit['end_line']}  {score_text(hit['score'])}\n{lines}"
