"""Unions of closed month intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_index(date: Column) -> Column:
    """Absolute month: year * 12 + month - 1."""
    return F.year(date) * 12 + F.month(date) - 1


def covered_months(df: DataFrame, key: str, start: str, end: str, unreadable_months: int = 12) -> DataFrame:
    """key, months (covered by the union of the intervals; touching ones merge), years (rounded half up).

    A null or reversed interval counts `unreadable_months`. Gaps and islands: an interval opens an island if it begins
    after the month that follows all ends before it.
    """
    own = df.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
    readable = F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("e") >= F.col("s"))
    other = own.where(~F.coalesce(readable, F.lit(False))).groupBy("k").agg((F.count(F.lit(1)) * unreadable_months).alias("more"))
    by_start = Window.partitionBy("k").orderBy("s", "e")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = own.where(readable).withColumn("opens", F.when(before.isNull() | (F.col("s") > before + 1), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = island.groupBy("k", "island").agg((F.max("e") - F.min("s") + 1).alias("m")).groupBy("k").agg(F.sum("m").alias("m"))
    months = F.coalesce("m", F.lit(0)) + F.coalesce("more", F.lit(0))
    return sizes.join(other, "k", "full").select(F.col("k").alias(key), months.cast("long").alias("months"), F.floor(months / 12 + 0.5).cast("long").alias("years"))
