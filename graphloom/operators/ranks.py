"""Ranks within keys of which one may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def ranked(rows: DataFrame, key: str, order: list[str], out: str = "rank", parts: int | None = None) -> DataFrame:
    """rows with the place of each within its key, from 1, in the order of columns; ties in any order, null keys are one key.

    Rows are cut into ranges by key and order, so a hot key is many ranges. Places are counted within a range's share of a key, and added to the
    sizes of the shares before: one row for each key and range. What a task sorts is one range, whatever a key holds.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id())
    cut = stored(cut.withColumn("_near", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))), "ranges")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(key, "_part").agg(F.count("*").alias("_n")).select(F.col(key).alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_far"))
    placed = cut.join(sizes, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return placed.select(*rows.columns, (F.col("_far") + F.col("_near")).cast("long").alias(out))


def beyond_first(rows: DataFrame, key: str, order: list[str], most: int, hub: int) -> tuple[DataFrame, Column]:
    """rows with a column, and whether a row of a key with over hub rows comes after the first most in the order of columns (rows like the last of these don't).

    A key's first rows are found by a rank that Spark limits before the exchange, so each task sends most of a key; the last of them goes
    back to the rows as one value of the key.
    """
    hubs = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hub).select(key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.join(hubs, key, "left_semi").withColumn("_r", rank).where(F.col("_r") <= most)
    name = f"_last_{key}"
    last = first.groupBy(key).agg(F.max(F.struct(*order)).alias(name))
    return rows.join(last, key, "left"), F.col(name).isNotNull() & (F.struct(*order) > F.col(name))
