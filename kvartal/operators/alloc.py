"""Exact integer allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


#: Bins of remainders in which the edge is looked for.
BINS = 4096


def largest_remainder(df: DataFrame, units: int, weight: str, key: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``share``: ``units`` shared by integer weight inside each group, leftovers by largest
    remainder, ties by least key. Fractions are compared as integer remainders, so nothing is rounded.

    Remainders are counted in bins: only the rows of the bin where the leftovers end are ranked,
    however large a group is. Weights times units, and remainders times BINS, must fit a long.
    """
    by = by or []
    groups = by or [F.lit(0).alias("_g")]
    names = by or ["_g"]
    rows = df if by else df.withColumn("_g", F.lit(0))
    rows = rows.join(df.groupBy(*groups).agg(F.sum(weight).alias("_total")), names)
    n = F.lit(units) * F.col(weight)
    rows = rows.withColumn("_rem", F.pmod(n, F.col("_total"))).withColumn("_base", F.floor((n - F.col("_rem")) / F.col("_total")).cast("long"))
    rows = rows.withColumn("_bin", F.floor(F.col("_rem") * BINS / F.col("_total")).cast("int"))
    bins = rows.groupBy(*names, "_bin").agg(F.count("*").alias("_n"), F.sum("_base").alias("_sum"))
    over = W.Window.partitionBy(*names)
    down = over.orderBy(F.col("_bin").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    left = F.lit(units) - F.sum("_sum").over(over)
    # what is left for a bin when those above it have taken theirs
    bins = bins.select(*names, "_bin", "_n", (left - F.sum("_n").over(down) + F.col("_n")).alias("_left"))
    rows = rows.join(bins, [*names, "_bin"])
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    rank = F.row_number().over(W.Window.partitionBy(*names).orderBy(F.col("_rem").desc(), key))
    inside = rows.where(edge).withColumn("_more", (rank <= F.col("_left")).cast("long"))
    rest = rows.where(~edge).withColumn("_more", (F.col("_left") > 0).cast("long"))
    return rest.unionByName(inside).withColumn("share", F.col("_base") + F.col("_more")).select(*df.columns, "share")


def give(df: DataFrame, amount: str, room: str, by: list[str]) -> DataFrame:
    """One stage of a capped cascade: each group's amount goes out by remaining room, at most all of it.

    Adds ``given`` (whole units, rounded down) and ``total`` room of the group, which is summed map-side.
    """
    rows = df.join(df.groupBy(*by).agg(F.sum(room).alias("total")), by)
    take = F.least(F.col(amount), F.col("total"))
    prod = take * F.col(room)
    given = F.when(F.col("total") > 0, F.floor((prod - F.pmod(prod, F.col("total"))) / F.col("total"))).otherwise(0)
    return rows.select(*df.columns, "total", given.cast("long").alias("given"))


def balanced_group(position: Column, size: Column, limit: int) -> Column:
    """Group number (from 0) of the position-th (from 0) of ``size`` members in the fewest groups of at most
    ``limit``, whose sizes differ by one at most."""
    groups = F.ceil(size / F.lit(limit))
    return F.floor((position * groups) / size).cast("long")
