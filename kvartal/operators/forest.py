"""Records that lie in larger records of their kind: a forest, and its roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.operators.shapes import double_area, near_shapes
from kvartal.scratch import Scratch

#: Side of the least cells that shapes are looked up by.
CELL = 64


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of (id, parent) links without cycles: each is told its parent's parent until nothing moves."""
    links = saved = scratch.save(links.select("id", F.col("parent").alias("root")), "links")
    while True:
        up = links.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
        new = scratch.save(links.join(up, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "links")
        scratch.drop(saved)
        saved = new
        if new.where("moved").isEmpty():
            return new.select("id", "root")
        links = new.drop("moved")


def contain(records: DataFrame) -> DataFrame:
    """(id, root) of records (id, kind, x, y, ring): the outermost record of its kind that each belongs to.

    A record belongs to the largest ring of its kind around its point, if that is larger than
    its own (of equal areas the greater id is larger); a record without a ring is smaller than
    any. Larger means that there are no cycles: the chain's end is the root, a record in none
    its own. Records without a point belong to no other.
    """
    scratch = Scratch(records.sparkSession, "forest")
    rows = records.select("id", "kind", "x", "y", "ring", F.when(F.col("ring").isNotNull(), double_area(F.col("ring"))).alias("size"))
    rows = scratch.save(rows, "records")
    areas = rows.where("ring IS NOT NULL").select(F.col("id").alias("s_id"), "kind", "ring", F.col("size").alias("area"))
    points = rows.select(F.col("id").alias("p_id"), "kind", "x", "y", "size")
    larger = F.col("size").isNull() | (F.col("area") > F.col("size")) | ((F.col("area") == F.col("size")) & (F.col("s_id") > F.col("p_id")))
    around = near_shapes(points, areas, CELL, by=["kind"]).where(larger)
    parent = around.groupBy("p_id").agg(F.max_by("s_id", F.struct("area", "s_id")).alias("parent"))
    up = roots(parent.select(F.col("p_id").alias("id"), "parent"), scratch)
    return rows.select("id").join(up, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def merged(records: DataFrame, root: DataFrame) -> DataFrame:
    """(id, ids, name) of each root: all ids that it stands for in order, and its name or else the first by id that is not empty."""
    both = records.select("id", "name").join(root, "id")
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    order = F.when(named, F.struct((F.col("id") != F.col("root")).alias("other"), F.col("id").alias("id")))
    return both.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.coalesce(F.min_by("name", order), F.lit("")).alias("name")).withColumnRenamed("root", "id")
