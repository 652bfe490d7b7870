"""Ranked phrase search of a whole table of queries over rows of which no index is kept.

No token or text is shuffled and no posting is written: each row is matched with the phrases where it is split, and leaves as the numbers of the phrases it holds. Queries with the same phrases are asked once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamdex.functions import scoring, text
from loamdex.operators import lexical
from loamdex.session import fresh_dir, materialise, materialised, remove, ship

#: Distinct queries that meet the rows in one pass; what is shipped with its tasks grows with this number alone.
BLOCK = 131_072
#: Matches that a worker holds at once.
MATCHES = 2_000_000


def distinct_queries(queries: DataFrame) -> DataFrame:
    """query_id, phrases, ask: the searchable queries; ``ask`` is the least query_id with the same phrases. Written once."""
    each = lexical.searchable(queries)
    return materialise(each.join(each.groupBy("phrases").agg(F.min("query_id").alias("ask")), "phrases").select("query_id", "phrases", "ask"), "asked")


@dataclass(frozen=True)
class Phrases:
    """The distinct phrases of some queries. Phrases of several terms are a tree: a node below ``len(terms)`` is a first term, ``steps`` are the sorted keys node * len(terms) + term that lead to the nodes ``to``."""

    terms: list[str]
    single: np.ndarray  # phrase of one term, by term; -1: none
    first: np.ndarray  # whether a longer phrase begins with the term
    steps: np.ndarray
    to: np.ndarray
    ends: np.ndarray  # phrase that ends at a node; -1: none
    number: int

    @staticmethod
    def of(asked: Iterable[list[list[str]]]) -> tuple[Phrases, list[list[int]]]:
        """The phrases, and the numbers of each query's."""
        terms: dict[str, int] = {}
        known: dict[tuple[int, ...], int] = {}
        lists = [[known.setdefault(tuple(terms.setdefault(t, len(terms)) for t in p), len(known)) for p in ps] for ps in asked]
        single, first = np.full(len(terms), -1, np.int32), np.zeros(len(terms), bool)
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for p, k in known.items():
            if len(p) == 1:
                single[p[0]] = k
                continue
            node, first[p[0]] = p[0], True
            for t in p[1:]:
                node = steps.setdefault(node * len(terms) + t, len(terms) + len(steps))
            ends[node] = k
        keys = np.array(sorted(steps), np.int64)
        last = np.full(len(terms) + len(steps), -1, np.int32)
        last[list(ends)] = list(ends.values())
        return Phrases(list(terms), single, first, keys, np.array([steps[k] for k in keys.tolist()], np.int64), last, len(known)), lists

    def found(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of each place where a phrase stands in the terms ``ids`` (-1: other words); ``place`` tells texts apart."""
        known = np.flatnonzero(ids >= 0)
        alone = self.single[ids[known]]
        at, what = [known[alone >= 0]], [alone[alone >= 0]]
        start = known[self.first[ids[known]]]
        node, depth = ids[start].astype(np.int64), 1
        while len(start) and len(self.steps):
            fits = start + depth < len(ids)
            start, node = start[fits], node[fits]
            here = ids[start + depth]
            fits = (here >= 0) & (place[start + depth] == place[start])
            start, key = start[fits], node[fits] * len(self.terms) + here[fits]
            step = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            fits = self.steps[step] == key
            start, node, depth = start[fits], self.to[step[fits]], depth + 1
            ended = self.ends[node]
            at.append(start[ended >= 0])
            what.append(ended[ended >= 0])
        return np.concatenate(at), np.concatenate(what)


def _matches(rows: DataFrame, phrases: Phrases, paths: DataFrame | None) -> DataFrame:
    """chunk_id, source_path, chunk_index, n_tokens, phrases, counts: which phrases each row holds and how often, all columns together. ``paths``: see ``search``; what a row holds meets its path as numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(phrases)
    keep = ["chunk_id", "source_path", "chunk_index"]
    if paths is None:
        return _matched(rows, shared, keep, lexical.COLUMNS)
    own = _matched(rows, shared, ["chunk_id", "file_id", "chunk_index"], [c for c in lexical.COLUMNS if c != "source_path"])
    return _matched(own.join(paths, "file_id"), shared, keep, ["source_path"])


def _matched(rows: DataFrame, shared: Broadcast, keep: list[str], columns: list[str]) -> DataFrame:
    """The columns ``keep``, n_tokens, phrases, counts: the phrases that stand in some columns, added to what the rows have found already."""
    before = [c for c in ("n_tokens", "phrases", "counts") if c in rows.columns]
    split = rows.select(*keep, *before, *[text.tokens(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)])
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(split.schema[k] for k in keep), T.StructField("n_tokens", T.LongType()), T.StructField("phrases", numbers), T.StructField("counts", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        terms = pa.array(p.terms, pa.string())
        for b in batches:
            n = b.num_rows
            lists = [b.column(f"_{i}") for i in range(len(columns))]
            sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            place = np.repeat(np.arange(n * len(lists)), np.concatenate(sizes))
            ids = np.concatenate([pc.fill_null(pc.index_in(x.flatten().cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False) for x in lists])
            at, what = p.found(ids, place)
            keys, counts = np.unique((place[at] % n) * max(p.number, 1) + what, return_counts=True)
            tokens = sum(sizes)
            if before:
                tokens = tokens + b.column("n_tokens").to_numpy()
                row = np.repeat(np.arange(n), pc.list_value_length(b.column("phrases")).to_numpy(zero_copy_only=False))
                had, often = (b.column(c).flatten().to_numpy() for c in ("phrases", "counts"))
                keys, which = np.unique(np.concatenate([keys, row * max(p.number, 1) + had]), return_inverse=True)
                counts = np.bincount(which, np.concatenate([counts, often]), len(keys))
            offsets = pa.array(np.searchsorted(keys, np.arange(n + 1) * max(p.number, 1)), pa.int32())
            out = [*(b.column(k) for k in keep), pa.array(tokens), *(pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % max(p.number, 1), counts))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return split.mapInArrow(run, schema)


@dataclass(frozen=True)
class _Asked:
    """Queries as numbers: query i has the phrases[offsets[i]:offsets[i + 1]], rarest first; ``weight`` by phrase."""

    asks: pa.Array
    offsets: np.ndarray
    phrases: np.ndarray
    weight: np.ndarray
    mean: float


def _first(score: np.ndarray, limit: int) -> np.ndarray:
    """The places of the ``limit`` least values, of equal ones the first."""
    if len(score) <= limit:
        return np.arange(len(score))
    last = np.partition(score, limit - 1)[limit - 1]
    less = np.flatnonzero(score < last)
    return np.concatenate([less, np.flatnonzero(score == last)[: limit - len(less)]])


def _ranked(held: list[pa.RecordBatch], asked: _Asked, best: np.ndarray, digits: int) -> pa.Table:
    """ask, chunk_id, score: the first hits of each query among the held rows, which are in the order that settles ties and behind all earlier ones. ``best`` has each query's scores so far; what they surpass is left out."""
    t = pa.Table.from_batches(held).combine_chunks()
    column = {c: t.column(c).combine_chunks() for c in t.column_names}
    sizes = pc.list_value_length(column["phrases"]).to_numpy(zero_copy_only=False)
    p, f = (column[c].flatten().to_numpy(zero_copy_only=False) for c in ("phrases", "counts"))
    order = np.argsort(p, kind="stable")
    row, p, f = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], p[order], f[order]
    share = scoring.bm25_part(asked.weight[p], f, column["n_tokens"].to_numpy(zero_copy_only=False)[row], asked.mean)
    start = np.searchsorted(p, np.arange(len(asked.weight) + 1))
    fewest = np.minimum.reduceat(np.diff(start)[asked.phrases], asked.offsets[:-1])
    limit, unit = best.shape[1], 10.0**digits
    asks, rows, scores = [], [], []
    for i in np.flatnonzero(fewest).tolist():
        a, *others = asked.phrases[asked.offsets[i] : asked.offsets[i + 1]].tolist()
        r, s = row[start[a] : start[a + 1]], share[start[a] : start[a + 1]]
        for k in others:
            if not len(r):
                break
            there = row[start[k] : start[k + 1]]
            at = np.minimum(np.searchsorted(there, r), len(there) - 1)
            meets = there[at] == r
            r, s = r[meets], s[meets] + share[start[k] + at[meets]]
        place = -np.floor(-s * unit + 0.5) / unit
        if best[i, -1] < np.inf:
            better = place < best[i, -1]
            r, s, place = r[better], s[better], place[better]
        if len(r):
            at = _first(place, limit)
            asks.append(np.full(len(at), i, np.int32))
            rows.append(r[at])
            scores.append(s[at])
            best[i] = np.sort(np.concatenate([best[i], place[at]]))[:limit]
    number, at, score = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((asks, np.int32), (rows, np.int32), (scores, np.float64)))
    return pa.table([asked.asks.take(pa.array(number)), column["chunk_id"].take(pa.array(at)), pa.array(score)], names=["ask", "chunk_id", "score"])


def _hits(found: DataFrame, asked: _Asked, kind: T.DataType, limit: int, digits: int) -> DataFrame:
    """ask, chunk_id, score: the first hits of each query in each task's share of the rows."""
    shared = found.sparkSession.sparkContext.broadcast(asked)
    most = MATCHES
    schema = T.StructType([T.StructField("ask", kind), found.schema["chunk_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(shared.value.asks), limit), np.inf)
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += len(b.column("phrases").flatten())
            if n >= most:
                yield from _ranked(held, shared.value, best, digits).to_batches(65_536)
                held, n = [], 0
        if n:
            yield from _ranked(held, shared.value, best, digits).to_batches(65_536)

    ordered = found.filter(F.size("phrases") > 0).sortWithinPartitions("source_path", "chunk_index", "chunk_id")
    return ordered.select("chunk_id", "n_tokens", "phrases", "counts").mapInArrow(run, schema)


def _block(spark: SparkSession, rows: DataFrame, asked: DataFrame, limit: int, digits: int, paths: DataFrame | None) -> DataFrame:
    """The hits of some distinct queries (ask, phrases); see ``search``. They are written once; the matches go again."""
    got = asked.toArrow()
    phrases, lists = Phrases.of(ps for b in got.select(["phrases"]).to_batches(4096) for ps in b.column(0).to_pylist())
    matches = fresh_dir(spark, "matches")
    found = materialised(_matches(rows, phrases, paths), matches)
    n_rows, tokens = lexical.totals(found)
    counted = found.select(F.explode("phrases").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).toArrow()
    having = np.zeros(phrases.number, np.int64)
    having[counted.column("p").to_numpy()] = counted.column("n").to_numpy()
    numbers = [k for ks in lists for k in sorted(ks, key=lambda k: (having[k], k))]
    offsets = np.cumsum([0, *map(len, lists)])
    weight = np.array([scoring.idf_value(n_rows, n) for n in having.tolist()])
    plan = _Asked(got.column("ask").combine_chunks(), offsets, np.array(numbers, np.int64), weight, tokens / max(n_rows, 1))
    tasks = max(spark.sparkContext.defaultParallelism, int(having.sum()) // MATCHES)  # each lets a query's first hits leave: no more than it takes
    hits = _hits(found.coalesce(tasks), plan, asked.schema["ask"].dataType, limit, digits)
    ranked = materialise(lexical.top_hits(hits.withColumnRenamed("ask", "query_id"), found, limit, digits=digits).withColumnRenamed("query_id", "ask"), "hits")
    remove(spark, matches)
    return ranked


def search(rows: DataFrame, asked: DataFrame, limit: int, digits: int = 12, paths: DataFrame | None = None) -> DataFrame:
    """ask, rank, chunk_id, score, source_path, chunk_index: the first ``limit`` rows of each distinct query of ``asked`` (see ``distinct_queries``), exactly; ties (scores equal to ``digits`` digits) by path, chunk_index, chunk_id.

    With ``paths`` (file_id, source_path; a file once) the rows have file_id in place of source_path, and rows of other files drop out: their texts are never shuffled.

    Every task ranks its share of the rows and lets only each query's first ``limit`` leave. More than BLOCK distinct queries take further passes over the rows.
    """
    spark = rows.sparkSession
    ship(spark)
    each = asked.filter("query_id = ask").select("ask", "phrases")
    blocks = max(1, -(-each.count() // BLOCK))
    hits = None
    for k in range(blocks):
        some = each.filter(F.pmod(F.xxhash64("ask"), F.lit(blocks)) == k) if blocks > 1 else each
        more = _block(spark, rows, some, limit, digits, paths)
        hits = more if hits is None else hits.unionByName(more)
    return hits
