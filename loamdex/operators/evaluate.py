"""Quality of rankings and percentiles of durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(ranking: DataFrame, grades: DataFrame) -> DataFrame:
    """query_id, recall_at_5, recall_at_10, reciprocal_rank, ndcg_at_10 for each query with an answer.

    ``ranking``: query_id, source_path, rank. ``grades``: query_id, source_path, grade (2 answer, 1 related). A query without hits has zeros. Gain is 2^grade - 1, discount log2(rank + 1).
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    known = grades.groupBy("query_id", "source_path").agg(F.max("grade").alias("grade"))
    ideal = known.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "source_path")))
    ideal = ideal.groupBy("query_id").agg(F.count_if(F.col("grade") >= 2).alias("answers"), F.sum(F.when(F.col("_n") <= 10, gain / F.log2(F.col("_n") + 1)).otherwise(0.0)).alias("ideal")).filter("answers > 0")
    hit = known.join(ranking.select("query_id", "source_path", "rank"), ["query_id", "source_path"])

    def found(k: int) -> Column:
        return F.count_if((F.col("grade") >= 2) & (F.col("rank") <= k))

    got = hit.groupBy("query_id").agg(found(5).alias("_5"), found(10).alias("_10"), F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("_first"), F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("_dcg"))
    zero = F.lit(0.0)
    return ideal.join(got, "query_id", "left").select(
        "query_id", F.coalesce(F.col("_5") / F.col("answers"), zero).alias("recall_at_5"), F.coalesce(F.col("_10") / F.col("answers"), zero).alias("recall_at_10"),
        F.coalesce(1.0 / F.col("_first"), zero).alias("reciprocal_rank"), F.coalesce(F.col("_dcg") / F.col("ideal"), zero).alias("ndcg_at_10"),
    )


def mean_metrics(metrics: DataFrame, by: str) -> DataFrame:
    """The mean of each metric for each ``by``."""
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("queries"), *[F.avg(c).alias(n) for c, n in (("recall_at_5", "recall_at_5"), ("recall_at_10", "recall_at_10"), ("reciprocal_rank", "mrr"), ("ndcg_at_10", "ndcg_at_10"))])


def below(means: DataFrame, thresholds: DataFrame, by: str) -> DataFrame:
    """by, metric, value, threshold of each mean below its threshold (the same columns)."""
    names = ["recall_at_5", "recall_at_10", "mrr", "ndcg_at_10"]
    both = means.join(thresholds.select(by, *[F.col(n).alias(f"_{n}") for n in names]), by)
    each = both.select(by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.col(f"_{n}").alias("threshold")) for n in names])).alias("x")).select(by, "x.*")
    return each.filter("value < threshold")


def percentiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, median, p95: nearest-rank percentiles, exact."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(by).agg(
        F.expr(f"percentile_disc(0.5) within group (order by {value})").alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95")
    )
