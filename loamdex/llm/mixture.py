"""Mixing sources to target shares of tokens.

Documents are spread over buckets by a hash of their id, encoded there, and packed into blocks of a fixed number of tokens; what is left of a source in each bucket is packed again, so a source has at most one short block. All slots of the mixture are permuted as one sequence, which draws how many slots of each output shard go to each source (multinomially, without replacement, so totals and caps hold exactly); slot k of a source takes the block that a pseudorandom permutation of the source's block numbers puts at place k, a new permutation for each pass over the source; blocks are joined by number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.llm.bpe import TOKENIZERS, largest_id, shared_encoder, slices
from loamdex.session import materialise, ship

#: Tokens of a block; slots of an output shard; characters of a bucket of documents on average (their number follows from the corpus, so the mixture doesn't depend on the cluster).
BLOCK, SHARD_SLOTS, BUCKET_CHARS = 512, 4096, 1 << 21
#: Most sources a table of targets may list; targets and totals are planned on the driver.
MAX_SOURCES = 10_000


def source_name(c: str) -> Column:
    """One spelling of a source: no white space around it, lower case, single underscores for spaces, hyphens and underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s_\-]+", "_")


@dataclass(frozen=True)
class SourcePlan:
    source: str
    target_share: float
    max_repeats: float
    tokens: int
    slots: int

    @property
    def blocks(self) -> int:
        return -(-self.tokens // BLOCK)


def plan_sources(targets: list[tuple[str, float, float]], tokens: dict[str, int], total: int | None = None) -> list[SourcePlan]:
    """How many slots each listed source gets.

    The mixture is as large as the caps allow (or ``total`` tokens, if that is less): the source that first reaches its cap sets the size. Sources without documents can't contribute; the others keep their shares in proportion.
    """
    usable = [(s, share, cap) for s, share, cap in targets if share > 0 and tokens.get(s, 0) > 0 and cap > 0]
    whole = sum(share for _, share, _ in usable)
    size = min([cap * tokens[s] / (share / whole) for s, share, cap in usable], default=0.0)
    if total is not None:
        size = min(size, total)
    slots = {s: int(min(size * share / whole, cap * tokens[s]) // BLOCK) for s, share, cap in usable}
    return [SourcePlan(s, share, cap, tokens.get(s, 0), slots.get(s, 0)) for s, share, cap in targets]


def permuted(index: np.ndarray, n: int, key: str) -> np.ndarray:
    """Where a pseudorandom permutation of range(n), chosen by ``key``, puts each index: a Feistel network over the next even number of bits, walked until it is in range."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key.encode()).digest(), np.uint64)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            x = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def packed(documents: DataFrame, buckets: int, vocabulary: str, kind: str) -> DataFrame:
    """source, bucket, at, ids: the blocks of each source in each bucket of (doc_id, source, text), numbered from 0; and what is left behind the last whole block, with ``at`` -1. The ids are bytes, numbers of the type ``kind``.

    Texts are shuffled once, ids not at all. A source's documents follow each other by a hash of their id; a source of any size is spread over all buckets.
    """
    block, parts = BLOCK, min(buckets, max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = documents.withColumns({"bucket": F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), "_order": F.xxhash64(F.lit(1), "doc_id")})
    placed = placed.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket", "source", "_order", "doc_id", F.xxhash64("text"))
    names = ["source", "bucket", "at", "ids"]

    def rows(key: tuple[int, str], first: int, tokens: list[int], last: bool) -> tuple[pa.RecordBatch, list[int]]:
        """The whole blocks of a run of tokens, and at its end the rest as well."""
        whole = len(tokens) // block
        lengths = [block] * whole
        numbers = list(range(first, first + whole))
        used = whole * block
        if last and used < len(tokens):
            lengths.append(len(tokens) - used)
            numbers.append(-1)
            used = len(tokens)
        raw, n = np.fromiter(tokens[:used], kind, used), len(numbers)
        offsets = (np.concatenate([[0], np.cumsum(lengths)]) * raw.itemsize).astype(np.int32)
        ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
        columns = [pa.array([key[1]] * n, pa.string()), pa.array([key[0]] * n, pa.int64()), pa.array(numbers, pa.int64()), ids]
        return pa.RecordBatch.from_arrays(columns, names=names), tokens[used:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key, first, held = shared_encoder(vocabulary), None, 0, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts, 4 << 20):
                for k, ids in zip(keys[a:b], encoder.encode(texts[a:b])):
                    if k != key:
                        if held:
                            yield rows(key, first, held, True)[0]
                        key, first, held = k, 0, []
                    held += ids
                    if len(held) >= 256 * block:
                        made, held = rows(key, first, held, False)
                        first += made.num_rows
                        yield made
        if held:
            yield rows(key, first, held, True)[0]

    return placed.select("bucket", "source", "text").mapInArrow(run, "source string, bucket long, at long, ids binary")


def before(df: DataFrame, group: str, order: str, value: str, name: str, step: int = 4096) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the group's rows of lower ``order`` (numbers from 0, one row each). Summed within steps and then over the steps, so no task sorts a whole group."""
    rows = df.withColumn("_step", F.floor(F.col(order) / step))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    steps = rows.groupBy(group, "_step").agg(F.sum(value).alias("_sum"))
    starts = steps.withColumn("_start", F.coalesce(F.sum("_sum").over(upto.partitionBy(group).orderBy("_step")), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(upto.partitionBy(group, "_step").orderBy(order)), F.lit(0))
    return rows.withColumn(name, inside).join(starts, [group, "_step"]).withColumn(name, F.col(name) + F.col("_start")).drop("_step", "_start")


def pack_rests(rests: DataFrame, block: int, width: int) -> DataFrame:
    """source, at, ids: rests (source, bucket, ids of ``width`` bytes each), laid end to end by bucket and cut at every ``block`` tokens; the last piece may be shorter."""
    placed = before(rests.select("source", "bucket", "ids", F.floor(F.octet_length("ids") / width).alias("n")), "source", "bucket", "n", "from")
    first, last = F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("n") - 1) / block)
    parts = placed.select("source", "from", "n", "ids", F.explode(F.sequence(first, last)).alias("at"))
    start = F.greatest(F.lit(0), F.col("at") * block - F.col("from"))
    stop = F.least(F.col("n"), (F.col("at") + 1) * block - F.col("from"))
    cut = F.substring(F.col("ids"), (start * width + 1).cast("int"), ((stop - start) * width).cast("int"))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("from", cut.alias("part")))), F.lit(b""), lambda all_, x: F.concat(all_, x["part"]))
    return parts.groupBy("source", "at").agg(joined.alias("ids"))


def numbered_blocks(found: DataFrame, block: int, width: int) -> DataFrame:
    """source, block_no, ids: whole blocks are numbered through the buckets of their source, those made of rests after them."""
    whole, rests = found.filter("at >= 0"), found.filter("at < 0")
    counts = whole.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = before(counts, "source", "bucket", "n", "start").select("source", "bucket", "start")
    ends = counts.groupBy("source").agg(F.sum("n").alias("whole"))
    one = whole.join(starts, ["source", "bucket"]).select("source", (F.col("start") + F.col("at")).alias("block_no"), "ids")
    two = pack_rests(rests, block, width).join(ends, "source", "left").select("source", (F.coalesce("whole", F.lit(0)) + F.col("at")).alias("block_no"), "ids")
    return one.unionByName(two)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    ``mixture``: shard, slot, source, block_no, pass, ids, a row for each block used. ``shares``: source, target_share, max_repeats, tokens (of the source), used (tokens of it in the mixture), actual_share, repeats, for every listed source.

    Sources are compared in one spelling (``source_name``); documents of unlisted, null or empty sources and null or empty texts take no part; a source listed without documents gets no share and is reported with 0. No source is used more than max_repeats times its tokens, no block more than max_repeats times rounded up. The same seed gives the same mixture. Empty tables give an empty mixture.
    """
    spark, block, shard_slots = documents.sparkSession, BLOCK, SHARD_SLOTS
    ship(spark)
    listed = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source")
    rows = listed.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    names = [r.source for r in rows]
    chosen = documents.select("doc_id", source_name("source").alias("source"), "text").filter(F.col("source").isin(names) & (F.length("text") > 0))
    size = chosen.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    kind = np.dtype("<u2" if largest_id(vocabulary) < 1 << 16 else "<u4")
    width = kind.itemsize
    found = materialise(packed(chosen, max(1, -(-size // BUCKET_CHARS)), vocabulary, kind.str), "blocks")
    tokens = {r.source: r.tokens for r in found.groupBy("source").agg(F.floor(F.sum(F.octet_length("ids").cast("long")) / width).alias("tokens")).collect()}
    plan = plan_sources([(r.source, r.target_share or 0.0, r.max_repeats or 0.0) for r in rows], tokens, total)
    used = [p for p in plan if p.slots]
    ends, blocks = np.cumsum([p.slots for p in used]), [p.blocks for p in used]
    slots, sources = int(ends[-1]) if used else 0, [p.source for p in used]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b["id"].to_numpy()
            which = np.searchsorted(ends, g, side="right")
            place = permuted(g, slots, f"{seed}/slots")
            for i in np.unique(which):
                mine = which == i
                k, n = g[mine] - (ends[i - 1] if i else 0), blocks[i]
                turn = k // n
                number = np.empty(len(k), np.int64)
                for t in np.unique(turn):
                    number[turn == t] = permuted(k[turn == t] % n, n, f"{seed}/{sources[i]}/{t}")
                yield pd.DataFrame({"shard": place[mine] // shard_slots, "slot": place[mine] % shard_slots + 1, "source": sources[i], "block_no": number, "pass": turn})

    drawn = spark.range(slots).mapInPandas(draw, "shard int, slot int, source string, block_no long, pass int")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(5)
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            values = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // width), pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], ids], names=[*b.schema.names[:5], "ids"])

    placed = drawn.join(numbered_blocks(found, block, width), ["source", "block_no"]).select("shard", "slot", "source", "block_no", "pass", "ids")
    mixture = placed.mapInArrow(numbers, "shard int, slot int, source string, block_no long, pass int, ids array<int>")

    known = spark.createDataFrame([(p.source, p.target_share, p.max_repeats, p.tokens) for p in plan], "source string, target_share double, max_repeats double, tokens long")
    last = drawn.join(known.select("source", "tokens"), "source").select("source", F.least(F.lit(block), F.col("tokens") - F.col("block_no") * block).alias("n"))
    shares = known.join(last.groupBy("source").agg(F.sum("n").alias("used")), "source", "left").fillna(0, ["used"])
    every = Window.partitionBy()  # one row a listed source
    shares = shares.select("source", "target_share", "max_repeats", "tokens", "used", (F.col("used") / F.nullif(F.sum("used").over(every), F.lit(0))).alias("actual_share"), (F.col("used") / F.nullif("tokens", F.lit(0))).alias("repeats"))
    return mixture, shares
