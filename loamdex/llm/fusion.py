"""One ranking from several scores whose scales don't compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.topn import positions
from loamdex.session import materialise


def side_places(hits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """query_id, chunk_id, lexical, semantic: each chunk's place on both sides, null where it is absent.

    ``hits`` has the columns of search_hits. Hybrid hits carry their places; the hits of the two single modes are placed by score among the distinct hits of the query and mode, null and NaN scores left out, best first, ties by source_path, chunk_index, chunk_id, hit_id. A chunk that several hits name takes its best place. Hits without query or chunk are left out. No task ever holds one query's hits as a whole: see ``positions``; the rest are aggregates.
    """
    hits = hits.filter("query_id is not null and chunk_id is not null")
    hybrid = hits.filter("query_mode = 'hybrid' and fused_ranks is not null").select(
        "query_id", "chunk_id", F.col("fused_ranks.lexical").cast("long").alias("lexical"), F.col("fused_ranks.semantic").cast("long").alias("semantic")
    )
    single = (
        hits.filter("query_mode in ('lexical', 'semantic') and score is not null and not isnan(score)")
        .select("query_id", "query_mode", "source_path", "chunk_index", "chunk_id", "hit_id", F.when(F.col("query_mode") == "lexical", F.col("score")).otherwise(-F.col("score")).alias("_key"))
        .distinct()
    )
    placed = positions(single, ["query_id", "query_mode"], [F.col(c) for c in ("_key", "source_path", "chunk_index", "chunk_id", "hit_id")], "_place", hot_rows)
    single = placed.select("query_id", "chunk_id", *[F.when(F.col("query_mode") == m, F.col("_place")).alias(m) for m in ("lexical", "semantic")])
    return hybrid.unionByName(single).groupBy("query_id", "chunk_id").agg(F.min("lexical").alias("lexical"), F.min("semantic").alias("semantic"))


def fill_absent(places: DataFrame, group: str, sides: list[str]) -> DataFrame:
    """Groups that have every side, with absent places set to the side's largest place plus 1 and ``_max_*`` beside them.

    The largest places are an aggregate of one row a group; joined back, a group with very many rows is split by adaptive execution's skew join. ``places`` is written once, as both sides of the join read it.
    """
    places = materialise(places, "places")
    most = places.groupBy(group).agg(*[F.max(s).alias(f"_max_{s}") for s in sides])
    most = most.filter(reduce(lambda a, b: a & b, [F.col(f"_max_{s}").isNotNull() for s in sides]))
    return places.join(most, group).withColumns({s: F.coalesce(F.col(s), F.col(f"_max_{s}") + 1) for s in sides})


def leximin_key(sides: list[str]):
    """A sort key, best first: each item's percentiles sorted ascending, compared as arrays, so that no strong side hides a weak one.

    A place p of m (absent: m + 1) is the percentile (m + 1 - p) / m.
    """
    return F.sort_array(F.array(*[(F.col(f"_max_{s}") + 1 - F.col(s)) / F.col(f"_max_{s}") for s in sides])).alias("leximin")


def leximin_ranking(places: DataFrame, group: str, item: str, sides: list[str]) -> DataFrame:
    """group, item, leximin (array of percentiles), rank: the whole leximin ranking of each group that has every side; ties go by item."""
    keyed = fill_absent(places, group, sides).select(group, item, leximin_key(sides))
    return positions(keyed, [group], [F.desc("leximin"), F.asc(item)], "rank")


def first_of_each(places: DataFrame, group: str, item: str, sides: list[str]) -> DataFrame:
    """group, item: the first item of the leximin ranking of each group that has every side, followed by an exact check of what TESTDATA.md defines.

    Leximin's first has the smallest sum of places in all data seen so far (see README), but need not in general: where the check finds a smaller sum, the item of the smallest sum stands instead (equal sums by leximin, then the smaller item). Leximin's first and the check are one aggregate of fixed size a group, combined on the map side.
    """
    total = reduce(lambda a, b: a + b, [F.col(s) for s in sides]).alias("sum")
    worst_first = F.transform(leximin_key(sides), lambda x: -x).alias("key")
    keyed = fill_absent(places, group, sides).select(group, F.struct(worst_first, F.col(item).alias("item"), total).alias("_first"), F.struct(total, worst_first, F.col(item).alias("item")).alias("_check"))
    best = keyed.groupBy(group).agg(F.min("_first").alias("_first"), F.min("_check").alias("_check"))
    return best.select(group, F.when(F.col("_check.sum") < F.col("_first.sum"), F.col("_check.item")).otherwise(F.col("_first.item")).alias(item))
