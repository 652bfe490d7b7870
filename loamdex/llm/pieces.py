"""Cutting oversized items into pieces at natural boundaries, by byte ranges.

Workers look at ranges of bytes with a halo of one byte and report a boundary table: how many tokens start in the range and where line breaks lie between them. Stitching the ranges' tables with prefix sums gives the boundary table of the item, from which the pieces are planned; contents are never shuffled and a giant item is never tokenized in one task. A token is a longest run of characters other than space, tab, CR and LF; these four are single bytes in UTF-8, so every cut of the bytes is safe.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import materialise, ship

#: Bytes of a range of a file, and of a value in a table, which is in memory as a whole and is only looked at in parts. They decide how the work is divided, never the pieces.
FILE_RANGE, VALUE_RANGE = 1 << 20, 1 << 12

_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 10, 13, 32]] = 1


def range_table(data: bytes, halo: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Boundary table of one range: the number of tokens that start in it; for each token before which lines change its number in the range and the line breaks in the range before it; all line breaks in it.

    The first ``halo`` bytes (0 or 1) belong to the range before: they tell whether a token goes on and whether an LF ends a CRLF.
    """
    raw = np.frombuffer(data, np.uint8)
    space = _CLASS[raw].astype(bool)
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    start = ~space & before
    breaks = (raw == 10) | (raw == 13)
    breaks[1:] &= ~((raw[1:] == 10) & (raw[:-1] == 13))
    start[:halo] = breaks[:halo] = False
    count = np.cumsum(breaks)
    lines = count[np.flatnonzero(start)]
    at = np.flatnonzero(np.diff(lines, prepend=0))
    return len(lines), at.astype(np.int32), lines[at].astype(np.int32), int(count[-1]) if len(raw) else 0


def stitch(tables: list[tuple[int, np.ndarray, np.ndarray, int]]) -> tuple[int, np.ndarray, np.ndarray]:
    """One table of consecutive ranges: tokens; tokens before which lines change; line breaks before each of these. Prefix sums only."""
    tokens, breaks, at, lines = 0, 0, [], []
    for n, where, count, total in tables:
        if n and breaks and not (len(where) and where[0] == 0):
            where, count = np.concatenate([[0], where]), np.concatenate([[0], count])
        at.append(np.asarray(where, np.int64) + tokens)
        lines.append(np.asarray(count, np.int64) + breaks)
        tokens, breaks = tokens + n, breaks + total
    at_all, line_all = np.concatenate(at or [[]]).astype(np.int64), np.concatenate(lines or [[]]).astype(np.int64)
    keep = np.diff(line_all, prepend=0) > 0
    return tokens, at_all[keep], line_all[keep]


def plan_pieces(tokens: int, at: np.ndarray, lines: np.ndarray, max_tokens: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first token, end token, line breaks before the first, before the last token) of each piece.

    New text ends at the last place that fits where two or more line breaks lie, else one, else after the last token that fits. An overlap of ``max_tokens`` or more is cut so that one new token fits.
    """
    single, step = at.tolist(), np.diff(lines, prepend=0)
    double = at[step >= 2].tolist()
    lines = lines.tolist()

    def line(token: int) -> int:
        i = bisect_right(single, token)
        return lines[i - 1] if i else 0

    out, at_new = [], 0
    while at_new < tokens:
        first = at_new - min(overlap, at_new, max_tokens - 1)
        end = first + max_tokens
        if end >= tokens:
            end = tokens
        else:
            for places in (double, single):
                i = bisect_right(places, end)
                if i and places[i - 1] > at_new:
                    end = places[i - 1]
                    break
        out.append((first, end, line(first), line(end - 1)))
        at_new = end
    return out


def file_ranges(files: DataFrame, range_bytes: int = FILE_RANGE) -> DataFrame:
    """Boundary tables of files (id, path, byte_size) on storage that all executors reach, by a plain path or a URI: each range is read by itself, with one byte of halo, so no task and no table ever holds a whole file. Rows as of ``boundary_tables``, with id as file_id too and lines from 1."""
    count = F.greatest(F.lit(1), F.ceil(F.col("byte_size") / range_bytes)).cast("int")
    spread = files.select("id", "path", count.alias("ranges"), F.explode(F.sequence(F.lit(0), count - 1)).alias("range_no"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                halo = min(1, r.range_no)
                found = range_table(read_bytes(r.path, r.range_no * range_bytes - halo, range_bytes + halo), halo)
                yield pd.DataFrame([(r.id, r.id, 1, r.range_no, r.ranges, *found)], columns=["item", "file_id", "start_line", "range_no", "ranges", "tokens", "places", "counts", "breaks"])

    return spread.repartition(_partitions(files), "id", "range_no").mapInPandas(run, _TABLE)


def _opened(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def read_bytes(path: str, at: int, size: int) -> bytes:
    with _opened(path) as f:
        f.seek(at)
        return f.read(size)


def _partitions(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_files(files: DataFrame, max_tokens: int, overlap: int, range_bytes: int = FILE_RANGE) -> DataFrame:
    """chunk_id (the file's id), piece_no, start_line, end_line, n_tokens, start_byte, end_byte, text of each piece of each file with more than ``max_tokens`` tokens.

    Two passes over ranges, none over whole files: the first gives the boundary tables from which the pieces are planned; the second finds the bytes at which the pieces' first and last tokens lie, each within its own range. A piece is then read by its offsets. An empty file has no pieces; overlap below 0 is 0.
    """
    ship(files.sparkSession)
    tables = materialise(file_ranges(files, range_bytes), "boundaries")
    limits = tables.withColumns({"max_tokens": F.lit(max_tokens), "overlap": F.lit(max(0, overlap))})
    pieces = materialise(_planned(limits), "pieces")
    before = Window.partitionBy("item").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = tables.select("item", "range_no", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    wanted = pieces.select(F.col("chunk_id").alias("item"), F.explode(F.array("first_token", F.col("end_token") - 1)).alias("token")).distinct()
    placed = wanted.join(starts, "item").filter("token >= first and token < first + tokens").groupBy("item", "range_no", "first").agg(F.collect_list("token").alias("sought"))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                halo = min(1, r.range_no)
                raw = np.frombuffer(read_bytes(r.path, r.range_no * range_bytes - halo, range_bytes + halo), np.uint8)
                space = _CLASS[raw].astype(bool)
                begins = np.flatnonzero(~space[halo:] & (np.concatenate([[True], space[:-1]])[halo:]))
                rows = []
                for token in r.sought:
                    a = r.range_no * range_bytes + int(begins[token - r.first])
                    rows.append((r.item, int(token), a, _token_end(r.path, a)))
                yield pd.DataFrame(rows, columns=["item", "token", "start_byte", "end_byte"])

    paths = files.select(F.col("id").alias("item"), "path")
    found = placed.join(paths, "item").mapInPandas(locate, "item long, token long, start_byte long, end_byte long")
    first = found.select(F.col("item").alias("chunk_id"), F.col("token").alias("first_token"), "start_byte")
    last = found.select(F.col("item").alias("chunk_id"), (F.col("token") + 1).alias("end_token"), "end_byte")
    cut = pieces.join(first, ["chunk_id", "first_token"]).join(last, ["chunk_id", "end_token"]).join(files.select(F.col("id").alias("chunk_id"), "path"), "chunk_id")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [read_bytes(p, a, e - a).decode("utf-8", "replace") for p, a, e in zip(b["path"], b["start_byte"], b["end_byte"])]
            yield b.drop(columns="path")

    shown = cut.select("chunk_id", "piece_no", "start_line", "end_line", "n_tokens", "start_byte", "end_byte", "path")
    return shown.mapInPandas(emit, "chunk_id long, piece_no int, start_line int, end_line int, n_tokens int, start_byte long, end_byte long, text string")


def _token_end(path: str, at: int, step: int = 4096) -> int:
    """The byte behind the token that starts at a byte; a token may go on over any number of ranges."""
    with _opened(path) as f:
        f.seek(at)
        end = at
        while part := f.read(step):
            spaces = np.flatnonzero(_CLASS[np.frombuffer(part, np.uint8)])
            if len(spaces):
                return end + int(spaces[0])
            end += len(part)
        return end


_TABLE = "item long, file_id long, start_line int, range_no int, ranges int, tokens int, places array<int>, counts array<int>, breaks int"


def boundary_tables(chunks: DataFrame, range_bytes: int = VALUE_RANGE) -> DataFrame:
    """A row for each range of each chunk: see ``range_table``. Null content is no case."""
    body = F.encode("content", "UTF-8")
    sized = chunks.filter("content is not null and id is not null").select("id", "file_id", "start_line", body.alias("body"))
    count = F.greatest(F.lit(1), F.ceil(F.length("body") / range_bytes)).cast("int")
    # A small body goes on as it is; a large one becomes ranges with a halo, cut by byte offset in the JVM.
    cut = F.when(count == 1, F.array(F.struct(F.lit(0).alias("range_no"), F.lit(0).alias("halo"), F.col("body").alias("part")))).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("range_no"), F.when(i == 0, 0).otherwise(1).alias("halo"), F.substring(F.col("body"), F.greatest(F.lit(1), i * range_bytes), F.when(i == 0, F.lit(range_bytes)).otherwise(F.lit(range_bytes + 1))).alias("part")))
    )
    ranged = sized.select("id", "file_id", "start_line", count.alias("ranges"), F.explode(cut).alias("r")).select("id", "file_id", "start_line", "r.range_no", "ranges", "r.halo", "r.part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [range_table(part, halo) for part, halo in zip(b.column(6).to_pylist(), b.column(5).to_pylist())]
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], ints), pa.array([x[2] for x in found], ints), pa.array([x[3] for x in found], pa.int32())],
                names=["item", "file_id", "start_line", "range_no", "ranges", "tokens", "places", "counts", "breaks"],
            )

    return ranged.mapInArrow(run, _TABLE)


def newest_limits(profiles: DataFrame) -> DataFrame:
    """file_id, max_tokens, overlap_tokens of each file's newest profile row; a null overlap is 0. Limits below 1 or null make no cases."""
    newest = profiles.filter("file_id is not null").groupBy("file_id").agg(F.max(F.struct("updated_at", "max_tokens", "overlap_tokens")).alias("p"))
    return newest.select("file_id", F.col("p.max_tokens").alias("max_tokens"), F.greatest(F.coalesce(F.col("p.overlap_tokens"), F.lit(0)), F.lit(0)).alias("overlap")).filter("max_tokens >= 1")


_PIECES = "chunk_id long, piece_no int, start_line int, end_line int, n_tokens int, first_token long, end_token long"


def _rows(item: int, start_line: int, tables: list, max_tokens: int, overlap: int) -> list[tuple]:
    tokens, at, lines = stitch(tables)
    if tokens <= max_tokens:
        return []
    plan = plan_pieces(tokens, at, lines, max_tokens, overlap)
    return [(item, i, start_line + a, start_line + b, end - first, first, end) for i, (first, end, a, b) in enumerate(plan)]


def _planned(tables: DataFrame) -> DataFrame:
    """The pieces of items from the tables of their ranges (repeated rows count once), with limits: one row of a few bytes a line meets for each item."""
    parts = F.array_sort(F.collect_set(F.struct("range_no", "tokens", "places", "counts", "breaks"))).alias("parts")
    items = tables.groupBy("item").agg(*[F.min(c).alias(c) for c in ("start_line", "max_tokens", "overlap")], parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples(index=False):
                once = {p["range_no"]: (p["tokens"], p["places"], p["counts"], p["breaks"]) for p in r.parts}
                rows += _rows(r.item, r.start_line, [once[n] for n in sorted(once)], r.max_tokens, r.overlap)
            yield _frame(rows)

    return items.mapInPandas(run, _PIECES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk_id", "piece_no", "start_line", "end_line", "n_tokens", "first_token", "end_token"])


def split_oversized(chunks: DataFrame, profiles: DataFrame, range_bytes: int = VALUE_RANGE) -> DataFrame:
    """chunk_id, piece_no, start_line, end_line, n_tokens, first_token, end_token: a row for each piece of each chunk with more tokens than its file's limit.

    Chunks of files without a profile are no cases; a null start_line counts as 1; repeated rows give their pieces once. Boundary tables are written once, so contents are read once; only these tables are shuffled and joined. The tables of a giant chunk's ranges meet to be stitched; they hold a few bytes a line.
    """
    ship(chunks.sparkSession)
    tables = materialise(boundary_tables(chunks, range_bytes), "boundaries")
    sized = tables.join(newest_limits(profiles), "file_id").withColumn("start_line", F.coalesce("start_line", F.lit(1)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.itertuples(index=False):
                rows += _rows(r.item, r.start_line, [(r.tokens, r.places, r.counts, r.breaks)], r.max_tokens, r.overlap)
            yield _frame(rows)

    small = sized.filter("ranges = 1 and tokens > max_tokens").mapInPandas(whole, _PIECES)
    return small.unionByName(_planned(sized.filter("ranges > 1"))).distinct()


def piece_texts(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``text``: from the first character of a piece's first token to the last of its last, as it stands in the chunk."""
    wanted = pieces.groupBy("chunk_id").agg(F.collect_list(F.struct("piece_no", "first_token", "end_token")).alias("cuts"))
    joined = chunks.groupBy(F.col("id").alias("chunk_id")).agg(F.first("content").alias("content")).join(wanted, "chunk_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                raw = np.frombuffer(data := r.content.encode(), np.uint8)
                space = np.concatenate([[True], _CLASS[raw].astype(bool), [True]])
                starts, ends = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
                rows += [(r.chunk_id, c["piece_no"], data[starts[c["first_token"]] : ends[c["end_token"] - 1]].decode()) for c in r.cuts]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "text"])

    texts = joined.mapInPandas(run, "chunk_id long, piece_no int, text string")
    return pieces.join(texts, ["chunk_id", "piece_no"])
