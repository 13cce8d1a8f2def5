"""Exact quantiles of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.scratch import Scratch


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(``by``, a column for each of ``at``): quantiles with linear interpolation, each group's.

    Equal values are counted before they move and dealt out by ranges of the order, so a
    group is spread over many tasks. Sums of the ranges say which of them hold a wanted
    rank, and only those are ordered. Null values do not count, and a group of nothing else
    has no row. A null group is a group.
    """
    scratch = Scratch(df.sparkSession, "quantiles")
    groups = [f"g{i}" for i in range(len(by))]
    plain = df.select(*(F.col(c).alias(g) for c, g in zip(by, groups)), F.col(value).alias("v")).where("v IS NOT NULL")
    counted = plain.groupBy(*groups, "v").agg(F.count("*").alias("n"))
    dealt = scratch.save(counted.repartitionByRange(*groups, "v").withColumn("part", F.spark_partition_id()), "values")

    # a row for each range of a group
    ranges = dealt.groupBy(*groups, "part").agg(F.sum("n").alias("rows"), F.min("v").alias("least"))
    group = W.Window.partitionBy(*groups)
    before = F.sum("rows").over(group.orderBy("least").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)) - F.col("rows")
    ranges = ranges.select(*groups, "part", "rows", before.alias("before"), F.sum("rows").over(group).alias("total"))
    place = {name: F.lit(float(q)) * (F.col("total") - 1) for name, q in at.items()}
    holds = reduce(lambda a, b: a | b, ((F.ceil(p) >= F.col("before")) & (F.floor(p) < F.col("before") + F.col("rows")) for p in place.values()))

    same = reduce(lambda a, b: a & b, (F.col(f"d.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups), F.col("d.part") == F.col("r.part"))
    held = dealt.alias("d").join(ranges.where(holds).alias("r"), same).select(*(f"d.{g}" for g in groups), "d.part", "v", "n", "before", "total")
    last = F.col("before") + F.sum("n").over(W.Window.partitionBy(*groups, "part").orderBy("v")) - 1
    held = held.withColumn("last", last).withColumn("first", F.col("last") - F.col("n") + 1)

    def at_rank(rank):
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("v")))

    ends = [e for name, p in place.items() for e in (at_rank(F.floor(p)).alias(f"lo_{name}"), at_rank(F.ceil(p)).alias(f"hi_{name}"))]
    out = held.groupBy(*groups).agg(F.max("total").alias("total"), *ends)

    def between(name):
        lo, hi, p = F.col(f"lo_{name}"), F.col(f"hi_{name}"), place[name]
        return F.when(lo == hi, lo.cast("double")).otherwise(lo + (hi - lo) * (p - F.floor(p)))

    return out.select(*(F.col(g).alias(c) for g, c in zip(groups, by)), *(between(name).alias(name) for name in at))
