"""What an indexing run has to do, by comparing what was found with what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_per(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys and ``columns`` of the row with the largest ``order`` of each key; one aggregate, combined on the map side, so a key with very many rows is no burden. Nulls order first."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def pending_paths(scans: DataFrame, files: DataFrame, profiles: DataFrame, runs: DataFrame) -> DataFrame:
    """source_path of each scanned path that the running run still has to process, once.

    The newest scan row of a path counts (scanned_at, then scan_id); a null hash means the file was rejected. It is pending if no run whose work stands (COMPLETE, PARTIAL) stored it, or the last such row differs in content_hash (case ignored), has no chunking profile, or none of the running run's chunking_version. Without a running run nothing is pending. Hot paths are handled by aggregates; joins are by path and by file and run.
    """
    running = runs.filter("status = 'RUNNING'").select("run_id", F.col("chunking_version").alias("_wanted"))
    standing = runs.filter("status in ('COMPLETE', 'PARTIAL')").select("run_id").distinct()
    found = newest_per(scans.join(running, "run_id"), ["source_path"], ["scanned_at", "scan_id"], ["content_hash", "_wanted"]).filter("content_hash is not null and source_path is not null")
    stored = newest_per(files.join(standing, "run_id").select("id", "source_path", "run_id", "content_hash"), ["source_path"], ["run_id", "id"], ["run_id", "id", "content_hash"]).withColumnRenamed("content_hash", "_stored")
    versions = profiles.groupBy("file_id", "run_id").agg(F.collect_set("chunking_version").alias("_versions"))
    known = stored.join(versions, (stored["id"] == versions["file_id"]) & (stored["run_id"] == versions["run_id"]), "left").select("source_path", "_stored", "_versions")
    same: Column = (F.lower("_stored") == F.lower("content_hash")) & F.array_contains("_versions", F.col("_wanted"))
    return found.join(known, "source_path", "left").filter(~F.coalesce(same, F.lit(False))).select("source_path")


def decisions(found: DataFrame, stored: DataFrame, fingerprint: str) -> DataFrame:
    """source_path, decision (NEW, CHANGED, RECHUNKED, UNCHANGED) of each file found.

    ``found``: source_path, content_hash, document_type. ``stored``: the same and chunking_fingerprint. RECHUNKED: the same bytes and type under other settings, or with no settings known.
    """
    old = stored.select("source_path", F.lower("content_hash").alias("_h"), F.col("document_type").alias("_t"), F.col("chunking_fingerprint").alias("_f"), F.lit(True).alias("_known"))
    kind = (
        F.when(F.col("_known").isNull(), "NEW")
        .when(~F.col("_h").eqNullSafe(F.lower("content_hash")) | ~F.col("_t").eqNullSafe(F.col("document_type")), "CHANGED")
        .when(~F.col("_f").eqNullSafe(F.lit(fingerprint)), "RECHUNKED")
        .otherwise("UNCHANGED")
    )
    return found.join(old, "source_path", "left").select("source_path", kind.alias("decision"))


def deletions(stored: DataFrame, found: DataFrame, rejected: int = 0, issues: int = 0, wanted: Column | None = None) -> DataFrame:
    """The stored files that were not found; none at all if anything was rejected or could not be scanned, as an incomplete scan proves no absence.

    ``wanted`` says which paths the settings admit: others were not looked for and stay. Whether a path is really gone is for the file system to say.
    """
    if rejected or issues:
        return stored.limit(0)
    looked_for = stored if wanted is None else stored.filter(wanted)
    return looked_for.join(found.select("source_path").distinct(), "source_path", "left_anti")


def replace_files(old: DataFrame, new: DataFrame, removed: DataFrame, key: str = "source_path") -> DataFrame:
    """The next snapshot of a table: rows of replaced and removed files give way to the new ones."""
    gone = new.select(key).union(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True)


def checked_removal(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """The stored files without the expected ones (source_path, content_hash); a file whose hash has changed since the plan fails the job."""
    both = stored.join(expected.select("source_path", F.col("content_hash").alias("_e")), "source_path", "left")
    safe = F.when(F.col("_e").isNull(), True).when(F.col("_e") == F.col("content_hash"), False).otherwise(F.raise_error(F.concat(F.lit("changed since it was planned: "), F.col("source_path"))))
    return both.filter(safe).drop("_e")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """file_id, chunks; repeated rows count once."""
    return chunks.select("file_id", "id").distinct().groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))


def run_counters(decided: DataFrame) -> DataFrame:
    """decision, files."""
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("files"))


def preview_totals(decided: DataFrame, sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """decision, files, chunks, estimated: what a run would do. Chunks of unchanged files are known (``counts``: source_path, chunks), others are estimated from type and bytes (``sizes``: source_path, document_type, byte_size)."""
    from loamdex.functions.text import chunk_estimate

    joined = decided.join(sizes, "source_path", "left").join(counts, "source_path", "left")
    known = (F.col("decision") == "UNCHANGED") & F.col("chunks").isNotNull()
    guess = chunk_estimate(F.col("document_type"), F.col("byte_size"))
    return joined.groupBy("decision").agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(known, F.col("chunks")).otherwise(guess)).alias("chunks"), F.max(~known).alias("estimated"))
