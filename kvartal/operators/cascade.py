"""Residents of cells go to buildings in eight stages, and what a stage cannot place goes on to a wider one.

Cell, zone and block each serve buildings of known use first and those of unknown use next, up to
what they have room for; then a block's rest goes out beyond that, and where a block has no
building to take any, to the nearest block that has. Everything is whole: up to room, shares are
rounded down and the rest goes on; beyond it a building gets what the running share grows by,
so that nobody is lost. A stage is a sum for each key and a join; no key is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.operators.grid import nearest_any
from kvartal.scratch import Scratch

STAGES = 8


def _capped(rows: DataFrame, pool: DataFrame, key: str, room: Column, stage: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with what the stage gives, and what is left of the pool (key, amount)."""
    rows = rows.withColumn("_room", F.greatest(room, F.lit(0)))
    totals = rows.where("_room > 0").groupBy(key).agg(F.sum("_room").alias("_total"))
    share = pool.join(totals, key).select(key, F.least("amount", "_total").alias("_take"), "_total")
    given = F.coalesce(F.call_function("div", F.col("_take") * F.col("_room"), F.col("_total")), F.lit(0))
    rows = rows.join(share, key, "left").withColumn(f"stage{stage}", given).withColumn("got", F.col("got") + F.col(f"stage{stage}")).drop("_room", "_take", "_total")
    rows = scratch.save(rows, f"stage{stage}")
    return rows, _left(pool, rows, key, stage)


def _beyond(rows: DataFrame, pool: DataFrame, weight: Column, stage: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same for blocks and without a limit: by weight, in the order of ids."""
    rows = rows.withColumn("_w", weight)
    by = W.Window.partitionBy("block")
    upto = F.sum("_w").over(by.orderBy("id").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    met = rows.withColumns({"_upto": upto, "_total": F.sum("_w").over(by)}).join(pool.withColumnRenamed("amount", "_amount"), "block", "left")
    at = lambda x: F.call_function("div", F.col("_amount") * x, F.col("_total"))
    given = F.when((F.col("_total") > 0) & F.col("_amount").isNotNull(), at(F.col("_upto")) - at(F.col("_upto") - F.col("_w"))).otherwise(0)
    rows = met.withColumn(f"stage{stage}", given.cast("long")).withColumn("got", F.col("got") + F.col(f"stage{stage}")).drop("_w", "_upto", "_total", "_amount")
    rows = scratch.save(rows, f"stage{stage}")
    return rows, _left(pool, rows, "block", stage)


def _left(pool: DataFrame, rows: DataFrame, key: str, stage: int) -> DataFrame:
    gone = rows.groupBy(key).agg(F.sum(f"stage{stage}").alias("_gone"))
    return pool.join(gone, key, "left").select(key, (F.col("amount") - F.coalesce("_gone", F.lit(0))).alias("amount")).where("amount > 0")


def cascade(buildings: DataFrame, cells: DataFrame, zones: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """Residents by building and stage, and those whom no building takes.

    ``buildings`` (id, cell, zone, known, unknown: floor areas of known and of unknown use), ``cells`` (cell, zone, amount), ``zones`` (zone,
    block, x, y, area); ``room`` residents a unit of area. Gives (id, stage1 .. stage8, got) of every building and (reason, amount):
    'outside' of cells without a zone that their buildings leave over, 'nowhere' where no block has a building. A
    building without cell or zone takes part in the other stages. Nobody is lost: both sums make all amounts.
    """
    scratch = Scratch(buildings.sparkSession, "cascade")
    of = zones.select("zone", "block")
    rows = buildings.select("id", "cell", "zone", "known", "unknown").join(of, "zone", "left").withColumn("got", F.lit(0).cast("long"))
    rows = scratch.save(rows, "buildings")
    free = lambda c: F.when(F.col(c) > 0, room * F.col(c) - F.col("got")).otherwise(0)
    pool = cells.groupBy("cell").agg(F.sum("amount").alias("amount"))
    where = cells.groupBy("cell").agg(F.min("zone").alias("zone"))
    outside = None
    for stage, key, area in ((1, "cell", "known"), (2, "cell", "unknown"), (3, "zone", "known"), (4, "zone", "unknown"), (5, "block", "known"), (6, "block", "unknown")):
        if stage == 3:
            pool = scratch.save(pool.join(where, "cell"), "rest")
            outside = pool.where("zone IS NULL").select("amount")
            pool = pool.where("zone IS NOT NULL").groupBy("zone").agg(F.sum("amount").alias("amount"))
        if stage == 5:
            pool = pool.join(of, "zone").groupBy("block").agg(F.sum("amount").alias("amount"))
        rows, pool = _capped(rows, pool, key, free(area), stage, scratch)
    both = F.when(F.col("block").isNotNull(), F.col("known") + F.col("unknown")).otherwise(0)
    rows, pool = _beyond(rows, pool, both, 7, scratch)
    pool = scratch.save(pool, "rest")

    middle = [F.call_function("div", F.sum(F.col("area") * F.col(c)), F.greatest(F.sum("area"), F.lit(1))).alias(c) for c in "xy"]
    centre = scratch.save(zones.groupBy("block").agg(*middle), "centres")
    able = rows.where("block IS NOT NULL").groupBy("block").agg(F.sum(both).alias("w")).where("w > 0")
    near = nearest_any(pool.join(centre, "block").select(F.col("block").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay")), able.join(centre, "block").select(F.col("block").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")))
    moved = scratch.save(pool.join(near, F.col("block") == F.col("a_id"), "left").select(F.col("b_id").alias("block"), "amount"), "moved")
    rows, _ = _beyond(rows, moved.where("block IS NOT NULL").groupBy("block").agg(F.sum("amount").alias("amount")), both, 8, scratch)
    lost = outside.select(F.lit("outside").alias("reason"), "amount").unionByName(moved.where("block IS NULL").select(F.lit("nowhere").alias("reason"), "amount")).groupBy("reason").agg(F.sum("amount").alias("amount"))
    return rows.select("id", *(f"stage{k}" for k in range(1, STAGES + 1)), "got"), lost
