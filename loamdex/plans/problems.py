"""Queries of the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.operators.incremental import newest_per, pending_paths
from loamdex.session import fresh_dir, table
from loamdex.streaming.changefeed import ChangeFeed


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """source_path of each path that the running run still has to process.

    The scan records are read as a log through a change feed of their own; a batch keeps the newest record of each path. They come in two deliveries, cut at the middle of the scanning time: the consumer of the first dies once its plan is written, so the next one replays that plan and then plans what the second delivery brought, of which many offsets lie below those already done.
    """
    scans = table(spark, d, "scanned_files")
    folder = fresh_dir(spark, "feed")
    span = scans.agg(F.expr("min(scanned_at) + (max(scanned_at) - min(scanned_at)) / 2").alias("middle")).first()
    first = scans.filter(F.col("scanned_at") <= F.lit(span.middle)) if span.middle else scans
    ChangeFeed(spark, folder, "source_path", "scan_id").next_batch(first)
    feed = ChangeFeed(spark, folder, "source_path", "scan_id")
    feed.run(scans, lambda log: newest_per(log, ["source_path", "run_id"], ["scanned_at", "scan_id"], ["scan_id", "content_hash", "scanned_at", "_offset"]))
    seen = feed.sink()
    return pending_paths(scans.limit(0) if seen is None else seen, table(spark, d, "files"), table(spark, d, "file_chunking_profiles"), table(spark, d, "index_runs"))


QUERIES = {"p4_found": p4_found}

SQL = {
    "p4_found": """
with v as (select chunking_version from index_runs where status = 'RUNNING'),
s as (select source_path, content_hash, row_number() over (partition by source_path order by scanned_at desc nulls last, scan_id desc) n from scanned_files where run_id in (select run_id from index_runs where status = 'RUNNING') and source_path is not null),
f as (select source_path, id, run_id, content_hash, row_number() over (partition by source_path order by run_id desc, id desc) n from files where run_id in (select run_id from index_runs where status in ('COMPLETE', 'PARTIAL')))
select source_path from s where n = 1 and content_hash is not null and source_path not in (
 select s.source_path from s join f using (source_path) join file_chunking_profiles p on p.file_id = f.id and p.run_id = f.run_id
 where s.n = 1 and f.n = 1 and lower(s.content_hash) = lower(f.content_hash) and p.chunking_version in (select chunking_version from v))""",
}
