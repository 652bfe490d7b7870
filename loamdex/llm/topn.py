"""The N best rows of every group, and exact positions within groups, whatever a group's size.

Both operators split groups by exact row counts: light groups go through an ordinary window, heavy groups through a range sort over all partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamdex.session import materialise

#: A group is heavy from this share of the rows that a shuffle partition holds on average; smaller groups than LEAST_HOT rows never are.
HOT_SHARE, LEAST_HOT = 0.25, 256
#: Most group hashes (8 bytes each) that are shipped with a task. All other groups hold less than 1/MAX_HOT of the rows, which an ordinary window spills and finishes.
MAX_HOT = 4096


def hot_hashes(df: DataFrame, keys: list[str], hot_rows: int | None = None, max_hot: int = MAX_HOT) -> list[int]:
    """Hashes of the heaviest groups with at least ``hot_rows`` rows (default: by HOT_SHARE), from exact counts.

    Counts are combined on the map side and written once, a few bytes a group; only hashes above the threshold are sorted, and at most ``max_hot`` of them reach the driver. Two groups with one hash are only treated alike. The threshold decides the way a group takes, never its rows.
    """
    counts = materialise(df.groupBy(F.xxhash64(*keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    if hot_rows is None:
        rows = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
        hot_rows = max(LEAST_HOT, HOT_SHARE * rows / _partitions(df))
    return [r["_h"] for r in counts.filter(F.col("_n") >= hot_rows).orderBy(F.desc("_n"), "_h").limit(max_hot).collect()]


def _split(df: DataFrame, keys: list[str], hot: list[int]) -> tuple[DataFrame, DataFrame]:
    is_hot = F.xxhash64(*keys).isin(hot)
    return df.filter(is_hot), df.filter(~is_hot)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, hot_rows: int | None = None) -> DataFrame:
    """The distinct rows of ``df`` that are among the first ``n`` of their group.

    ``order`` must end in columns that tell any two different rows apart, so that the result is the same each time; rows equal in all columns count once. A null key is a group of its own. ``n`` below 1 gives no rows, an empty input an empty result. ``df`` should hold only the columns wanted.

    Heavy groups are made distinct by a hash aggregate, sorted by range across all partitions (the partition is the salt), cut to ``n`` within each (group, salt), and only those few rows meet in one task. Light groups take one window, whose group limit cuts rows before the shuffle.
    """
    if n < 1:
        return df.limit(0)
    hot = hot_hashes(df, keys, hot_rows)
    if not hot:
        return _window_top(df, keys, order, n).distinct()
    heavy, light = _split(df, keys, hot)
    ranged = (
        heavy.distinct()
        .repartitionByRange(_partitions(df), *keys, *order)
        .withColumn("_salt", F.spark_partition_id())
    )
    local = _window_top(ranged, [*keys, "_salt"], order, n).drop("_salt")
    return _window_top(light, keys, order, n).distinct().unionByName(_window_top(local, keys, order, n))


def _partitions(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _window_top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Equal rows share a dense rank, so repeated rows take no places."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.dense_rank().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``name``, each row's position from 1 within its group.

    Heavy groups are sorted by range; a row's position is its place in its range plus the rows of the ranges before, so no group has to fit one task. The ranged rows are written once, as two reads of an unwritten range sort could draw different borders.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    hot = hot_hashes(df, keys, hot_rows)
    if not hot:
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    heavy, light = _split(df, keys, hot)
    ranged = materialise(
        heavy.repartitionByRange(_partitions(df), *keys, *order).withColumn("_salt", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = ranged.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    s = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_salt"])], "_before")
    cond = None
    for i, k in enumerate([*keys, "_salt"]):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        cond = c if cond is None else cond & c
    joined = ranked.join(s, cond, "left")
    return (
        light.withColumn(name, F.row_number().over(w).cast("long"))
        .unionByName(joined.withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).select(*df.columns, name))
    )
