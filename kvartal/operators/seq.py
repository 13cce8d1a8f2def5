"""Sequences: prefix ids at any size, islands, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def prefix_sum(df: DataFrame, value: str, order: str, out: str, width: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` of all rows before, by the integer column ``order``.

    Two levels: a sum for each bucket of ``width`` orders, their running sums, then a
    window inside each bucket. No window spans all rows; the running sums span one row a bucket.
    """
    b = F.floor(F.col(order) / F.lit(width))
    sums = df.groupBy(b.alias("_b")).agg(F.sum(value).alias("_s"))
    # buckets are again cut in buckets, so that this window stays small at any size
    upper = sums.groupBy(F.floor(F.col("_b") / F.lit(width)).alias("_u")).agg(F.sum("_s").alias("_us"))
    upper = upper.select("_u", (F.sum("_us").over(W.Window.orderBy("_u")) - F.col("_us")).alias("_before"))
    inner = W.Window.partitionBy("_u").orderBy("_b")
    starts = sums.withColumn("_u", F.floor(F.col("_b") / F.lit(width))).join(upper, "_u")
    starts = starts.select("_b", (F.col("_before") + F.sum("_s").over(inner) - F.col("_s")).alias("_start"))
    own = W.Window.partitionBy("_b").orderBy(order)
    rows = df.withColumn("_b", b).join(starts, "_b")
    return rows.withColumn(out, F.col("_start") + F.sum(value).over(own) - F.col(value)).drop("_b", "_start")


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, out: str) -> DataFrame:
    """``df`` with the number (from 0) of each run of rows; ``breaks`` is true where a new run begins."""
    w = W.Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.sum(F.coalesce(breaks, F.lit(False)).cast("long")).over(w))
