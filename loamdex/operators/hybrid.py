"""Fusing lexical and semantic rankings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamdex.functions import scoring


def fuse(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """query_id, rank, chunk_id, score, lexical_rank, semantic_rank, source_path, chunk_index.

    Each side (query_id, rank, chunk_id, source_path, chunk_index) counts down to a fixed depth whatever the limit, so a smaller limit gives a prefix of a larger one. A chunk that stands twice on a side, or at different positions on both, is an error. Chunks are joined fully, an empty side is no obstacle; ties go by path, chunk_index, chunk_id. ``queries`` has query_id and shape.
    """
    sides = []
    for df, name in ((lexical, "lexical_rank"), (semantic, "semantic_rank")):
        sides.append(df.filter(F.col("rank") <= scoring.DEPTH).select("query_id", "chunk_id", "source_path", "chunk_index", *[F.col("rank").cast("int").alias(n) if n == name else F.lit(None).cast("int").alias(n) for n in ("lexical_rank", "semantic_rank")]))
    ranks, places = ("lexical_rank", "semantic_rank"), ("source_path", "chunk_index")
    seen = sides[0].unionByName(sides[1]).groupBy("query_id", "chunk_id").agg(*[F.min(c).alias(c) for c in (*ranks, *places)], *[F.count(c).alias(f"_n_{c}") for c in ranks], *[F.max(c).alias(f"_max_{c}") for c in places])
    twice, moved = reduce(or_, [F.col(f"_n_{c}") > 1 for c in ranks]), reduce(or_, [F.col(c) != F.col(f"_max_{c}") for c in places])
    name = F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))
    fine = F.when(twice, F.raise_error(F.concat(name, F.lit(" stands twice on a side")))).when(moved, F.raise_error(F.concat(name, F.lit(" has different positions on both sides")))).otherwise(True)
    both = seen.filter(fine).select("query_id", "chunk_id", *ranks, *places)
    scored = both.join(queries.select("query_id", "shape"), "query_id").withColumn("score", scoring.rrf(F.col("lexical_rank"), F.col("semantic_rank"), F.col("shape")))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "source_path", "chunk_index", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("query_id", "rank", "chunk_id", "score", "lexical_rank", "semantic_rank", "source_path", "chunk_index")


def collapse_to_files(hits: DataFrame) -> DataFrame:
    """query_id, source_path, rank of each file by its first hit, numbered anew from 1."""
    first = hits.groupBy("query_id", "source_path").agg(F.min("rank").alias("_first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "source_path"))).select("query_id", "source_path", "rank")
