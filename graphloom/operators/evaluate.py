"""Evaluation: means over runs, trends, merged reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def means(rows: DataFrame, key: str, metrics: list[str], order: list[str] | None = None, scale: float = 1.0) -> DataFrame:
    """For each key: n, means of the metrics, coverage (share of the rows with facts, times scale, which is multiplied before dividing), failures (no facts); null facts are neither. Sums of doubles depend on their order: with order, the metrics
    of a key are added up row by row in that order, however the rows are dealt; a key's rows then pass through one task, which holds none of them."""
    if order:
        own = Window.partitionBy(key).orderBy(*order)
        for m in metrics:
            rows = rows.withColumns({f"_n_{m}": F.count(m).over(own.rowsBetween(Window.unboundedPreceding, 0)), f"_s_{m}": F.sum(F.col(m).cast("double")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
        mean = lambda m: (F.max_by(f"_s_{m}", F.struct(*order)) / F.max(f"_n_{m}")).alias(m)
    else:
        mean = lambda m: F.avg(m).alias(m)
    return rows.groupBy(key).agg(F.count("*").alias("n"), *map(mean, metrics), (F.lit(scale) * F.count_if(F.col("facts") > 0) / F.count("*")).alias("coverage"), F.count_if(F.col("facts") <= 0).alias("failures"))


def fact_recall(rows: DataFrame, key: str, scale: float = 1.0) -> DataFrame:
    """For each key of rows (found, total): facts found among all facts asked for, over all rows together, times scale, which is multiplied before dividing; a row without facts counts as one."""
    return rows.groupBy(key).agg((F.lit(scale) * F.sum("found") / F.sum(F.greatest("total", F.lit(1)))).alias("fact_recall"))


def kb_list(rows: DataFrame, key: str, seq: list[str], recent: int) -> DataFrame:
    """(key, last, place): the recent keys used last, the latest first, then all others by name."""
    last = rows.groupBy(key).agg(F.max(F.struct(*seq)).alias("_l"))
    top = last.orderBy(F.desc("_l"), key).limit(recent).withColumn("_t", F.lit(1))
    out = last.join(F.broadcast(top.select(key, "_t")), key, "left")
    return out.select(key, F.col("_l")[seq[0]].alias("last"), F.col("_t").isNotNull().alias("recent")).orderBy(F.desc("recent"), F.when(F.col("recent"), F.col("last")).desc(), key)


def best_and_worst(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """One row: best and worst key by a metric, ties by name."""
    return rows.agg(F.min_by(key, F.struct(-F.col(metric), key)).alias("best"), F.min_by(key, F.struct(F.col(metric), key)).alias("worst"))


def trend(rows: DataFrame, key: str, order: list[str], metric: str, drop: float = -0.05) -> DataFrame:
    """rows with delta to the previous run of the key and whether it is a regression."""
    delta = F.col(metric) - F.lag(metric).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("delta", delta).withColumn("regression", F.coalesce(F.col("delta") < drop, F.lit(False)))


def merge_reports(rows: DataFrame, key: str) -> DataFrame:
    """One report per key of reports (doc_index, chunks, merge_skipped, last_reason)."""
    return rows.groupBy(key).agg(F.sum("chunks").alias("chunks"), F.bool_or("merge_skipped").alias("merge_skipped"), F.max_by("last_reason", "doc_index").alias("last_reason"))
