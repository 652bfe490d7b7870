"""Processing only new or changed records of a log, without losing or repeating any.

A log is split into partitions by the hash of its key. For each partition the consumer keeps the highest offset done and a fingerprint (count and two 64-bit sums) of the records it had seen up to there. A record above the mark is new. If what lies at or below the mark is no longer what the fingerprint says, records came late, and only such partitions are compared with the records of earlier plans, so nothing is lost in whatever order records arrive and a log in order is never compared with its history.

A batch is planned first: the plan (the key and offset of each of its records, and for each partition their lowest and highest offset) is written ahead of the work. A run that dies leaves its plan behind; the next run replays exactly that plan before it makes a new one. A batch's output goes to a folder of its own number, written anew on replay, with one row for each key and offset; as no record is in two plans, the folders together repeat nothing either.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamdex.sources.storage import Folder

#: Partitions of a log; plans and commits hold a few numbers for each.
PARTITIONS = 64


@dataclass(frozen=True)
class Mark:
    """How far a log partition is done: the highest offset, and count and sums of the records seen up to it."""

    end: int
    count: int = 0
    sum1: int = 0
    sum2: int = 0


@dataclass(frozen=True)
class Batch:
    """A planned batch: for each log partition its lowest and highest offset; the key and ``_offset`` of its records; the marks that hold once it is done; whether a failed run left it."""

    number: int
    ranges: dict[int, tuple[int, int]]
    records: DataFrame
    marks: dict[int, Mark]
    replayed: bool = False

    def of(self, log: DataFrame) -> DataFrame:
        """The batch's records of a log with ``_partition`` and ``_offset``; the ranges keep most others out of the join."""
        if not self.ranges:
            return log.limit(0)
        low, high = (_by_partition({p: r[i] for p, r in self.ranges.items()}) for i in (0, 1))
        return log.filter(F.col("_offset").between(low, high)).join(self.records, self.records.columns, "left_semi")


def _by_partition(numbers: dict[int, int]) -> Column:
    """The number of the row's log partition, null if it has none."""
    if not numbers:
        return F.lit(None).cast("long")
    return F.element_at(F.map_from_arrays(F.array(*[F.lit(p) for p in numbers]), F.array(*[F.lit(n).cast("long") for n in numbers.values()])), F.col("_partition"))


class ChangeFeed:
    """The state of one consumer of a log below ``folder`` (in storage that all executors share).

    ``key`` and ``offset`` are the columns that identify and order records; they may come in any order. Records with a null key or offset can't be placed in the log and are no records. Extra columns are carried along.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, offset: str, partitions: int = PARTITIONS):
        self.spark, self.folder, self.key, self.offset, self.partitions = spark, folder.rstrip("/"), key, offset, partitions
        self.plans, self.commits, self.looks = (Folder(spark, f"{self.folder}/{n}") for n in ("plans", "commits", "looks"))

    def _log(self, records: DataFrame) -> DataFrame:
        placed = records.filter(F.col(self.key).isNotNull() & F.col(self.offset).isNotNull())
        return placed.withColumns({"_partition": F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int"), "_offset": F.col(self.offset).cast("long")})

    def _numbers(self, folder: Folder) -> list[int]:
        return [int(n[:-5]) for n in folder.names() if n.endswith(".json") and n[0] != "_"]

    def _merged(self, kind: str) -> int:
        """The last batch in the newest whole merged folder of a kind; -1 if there is none."""
        folder = Folder(self.spark, f"{self.folder}/{kind}")
        return max((int(n[5:]) for n in folder.names() if n.startswith("upto=") and folder.exists(f"{n}/_SUCCESS")), default=-1)

    def _parts(self, kind: str) -> list[str]:
        """The folders that hold what all committed batches wrote."""
        merged = self._merged(kind)
        numbers = [n for n in self._numbers(self.commits) if n > merged]
        return [f"{self.folder}/{kind}/upto={merged}"] * (merged >= 0) + [f"{self.folder}/{kind}/batch={n}" for n in numbers]

    def _planned(self, paths: list[str], log: DataFrame) -> DataFrame:
        """The key, ``_partition`` and ``_offset`` of the records of some plans."""
        return self.spark.read.schema(log.select(self.key, "_partition", "_offset").schema).parquet(*paths)

    def _marks(self) -> dict[int, Mark]:
        """The marks of the last commit, or of a later look that found nothing new."""
        numbers = self._numbers(self.commits)
        if not numbers:
            return {}
        return _parse(json.loads(self.looks.latest(f"{numbers[-1]:09d}-") or self.commits.read(f"{numbers[-1]:09d}.json")))

    def committed(self) -> dict[int, int]:
        """The highest offset done in each log partition; lower ones may still come."""
        return {p: m.end for p, m in self._marks().items()}

    def next_batch(self, records: DataFrame) -> Batch | None:
        """The plan that a failed run left, or else a new one, written before it is returned; None if there is nothing new.

        The records are written first and the plan's ranges after them, so a plan is whole or not there.
        """
        log = self._log(records)
        plans, done = self._numbers(self.plans), set(self._numbers(self.commits))
        for number in plans:
            if number not in done:
                plan = json.loads(self.plans.read(f"{number:09d}.json"))
                records = self._planned([f"{self.folder}/planned/batch={number}"], log).drop("_partition")
                return Batch(number, {int(p): tuple(r) for p, r in plan["ranges"].items()}, records, _parse(plan["marks"]), replayed=True)
        marks = self._marks()
        found, late = self._look(log, marks)
        end = _by_partition({p: m.end for p, m in marks.items()})
        new = log.select(self.key, "_partition", "_offset")
        fresh = new.filter(end.isNull() | (F.col("_offset") > end))
        if late:
            below = new.filter(F.col("_partition").isin(late) & (F.col("_offset") <= end))
            old = self._planned(self._parts("planned"), log).filter(F.col("_partition").isin(late)).drop("_partition")
            fresh = fresh.unionByName(below.join(old, [self.key, "_offset"], "left_anti"))
        number = max([*plans, *done], default=-1) + 1
        path = f"{self.folder}/planned/batch={number}"
        fresh.write.mode("overwrite").parquet(path)
        pairs = self._planned([path], log)
        ranges = {r["_partition"]: (r["a"], r["b"]) for r in pairs.groupBy("_partition").agg(F.min("_offset").alias("a"), F.max("_offset").alias("b")).orderBy("_partition").collect()}
        marks |= found
        if not ranges:
            Folder(self.spark, f"{self.folder}/planned").remove(f"batch={number}")
            if late:
                self.looks.write(f"{max(done):09d}-{len(self.looks.names())}", _text(marks))
            return None
        self.plans.write(f"{number:09d}.json", json.dumps({"ranges": ranges, "marks": json.loads(_text(marks))}))
        return Batch(number, ranges, pairs.drop("_partition"), marks)

    def _look(self, log: DataFrame, marks: dict[int, Mark]) -> tuple[dict[int, Mark], list[int]]:
        """(marks of the partitions as the log stands now, partitions with other records at or below their mark than when it was set); one aggregate, combined on the map side, of a few numbers a partition."""
        end = _by_partition({p: m.end for p, m in marks.items()})
        below = F.col("_offset") <= end
        sums = [F.xxhash64(F.lit(i), self.key, "_offset") for i in (1, 2)]
        aggs = [F.max("_offset").alias("top"), F.count(F.lit(1)).alias("n"), *[F.bit_xor(s).alias(f"s{i}") for i, s in enumerate(sums)]]
        aggs += [F.count_if(below).alias("bn"), *[F.coalesce(F.bit_xor(F.when(below, s)), F.lit(0)).alias(f"b{i}") for i, s in enumerate(sums)]]
        found, late = {}, []
        for r in log.groupBy("_partition").agg(*aggs).collect():
            p, old = r["_partition"], marks.get(r["_partition"])
            if old and r.bn and (r.bn, r.b0, r.b1) != (old.count, old.sum1, old.sum2):
                late.append(p)
            found[p] = Mark(max(r.top, old.end) if old else r.top, r.n, r.s0, r.s1)
        return found, late

    def run(self, records: DataFrame, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Does what is open and then all that is new, as one batch; the number of batches done.

        ``work`` maps the records of a batch to the rows to store; it must keep ``_offset`` and the key, by which the sink tells rows apart.
        """
        done = 0
        while batch := self.next_batch(records):
            self._write(batch, work(batch.of(self._log(records))))
            self._commit(batch)
            done += 1
            if not batch.replayed:
                break
        return done

    def follow(self, stream: DataFrame, work: Callable[[DataFrame], DataFrame] = lambda df: df):
        """Feeds a streaming DataFrame through ``run``, micro-batch by micro-batch, until all that is there is done; the started query is returned.

        A micro-batch that is delivered again after a failure meets the plan that the failed one left, or nothing that is new.
        """

        def step(records: DataFrame, _: int) -> None:
            self.run(records, work)

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start()

    def _write(self, batch: Batch, rows: DataFrame) -> None:
        """One row for each key and offset, whatever was delivered twice."""
        rows.drop("_partition").dropDuplicates([self.key, "_offset"]).write.mode("overwrite").parquet(f"{self.folder}/sink/batch={batch.number}")

    def _commit(self, batch: Batch) -> None:
        self.commits.write(f"{batch.number:09d}.json", _text(batch.marks))

    def sink(self) -> DataFrame | None:
        """The rows of all committed batches; None before the first commit. Read as they lie: no shuffle of what earlier batches wrote."""
        parts = self._parts("sink")
        return self.spark.read.option("mergeSchema", "false").parquet(*parts) if parts else None

    def compact(self) -> None:
        """Merges the folders of all committed batches into one for plans and one for the sink.

        What a merge replaces goes at the next one, for readers that began before. A merge that dies leaves an unfinished folder, which doesn't count.
        """
        numbers = self._numbers(self.commits)
        if not numbers:
            return
        for kind in ("planned", "sink"):
            folder, merged, parts = Folder(self.spark, f"{self.folder}/{kind}"), self._merged(kind), self._parts(kind)
            for name in folder.names():
                if name.startswith("upto=") and int(name[5:]) < merged or name.startswith("batch=") and int(name[6:]) <= merged:
                    folder.remove(name)
            if numbers[-1] > merged:
                self.spark.read.parquet(*parts).write.mode("overwrite").parquet(f"{self.folder}/{kind}/upto={numbers[-1]}")
        for folder in (self.plans, self.commits):  # plans first: one without its commit would be replayed
            for n in numbers[:-1]:
                folder.remove(f"{n:09d}.json")


def _text(marks: dict[int, Mark]) -> str:
    return json.dumps({p: [m.end, m.count, m.sum1, m.sum2] for p, m in marks.items()})


def _parse(marks: dict) -> dict[int, Mark]:
    return {int(p): Mark(*m) for p, m in marks.items()}
