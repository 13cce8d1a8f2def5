"""Closed rings from ways that share end points, and what an assembled relation replaces.

A way can be travelled both ways: each direction is a dart, and at a point where two ends
meet, the dart that arrives by one leaves by the other. So darts form cycles, and each knows
the next. Pointer jumping doubles what a dart sees of its cycle in every round: the least dart
ahead and how far ahead it is. Rounds grow with the logarithm of the longest ring, and a
round is one join of darts with darts: no ring is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.scratch import Scratch


def _darts(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(relation, dart, next) of relations all of whose points have two ends. A dart is 2 * way, and 1 more from b to a."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))).alias("e")
    ends = members.select("relation", "way", "a", "b").distinct().select("relation", "way", sides).select("relation", F.col("e.node").alias("node"), F.struct("way", "e.side").alias("end"))
    points = scratch.save(ends.groupBy("relation", "node").agg(F.count("*").alias("n"), F.min("end").alias("one"), F.max("end").alias("two")), "points")
    broken = points.where("n <> 2 OR node IS NULL").select("relation").distinct()
    whole = points.join(broken, "relation", "left_anti")
    arrives = lambda e: F.col(f"{e}.way") * 2 + (1 - F.col(f"{e}.side"))
    leaves = lambda e: F.col(f"{e}.way") * 2 + F.col(f"{e}.side")
    both = F.explode(F.array(*(F.struct(arrives(x).alias("dart"), leaves(y).alias("next")) for x, y in (("one", "two"), ("two", "one")))))
    return whole.select("relation", both.alias("d")).select("relation", "d.dart", "d.next")


def cycles(darts: DataFrame, scratch: Scratch) -> DataFrame:
    """(relation, dart, low, ahead) of darts (relation, dart, next): the least dart of the cycle and how many steps ahead it is."""
    seen = scratch.save(darts.select("relation", "dart", F.col("next").alias("to"), F.col("dart").alias("low"), F.lit(0).cast("long").alias("ahead")), "seen")
    saved, length = seen, 1
    while True:
        there = seen.select(F.col("relation").alias("_r"), F.col("dart").alias("_d"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("ahead").alias("_ahead"))
        met = seen.join(there, (F.col("relation") == F.col("_r")) & (F.col("to") == F.col("_d")))
        nearer = F.col("_low") < F.col("low")
        new = scratch.save(
            met.select("relation", "dart", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.when(nearer, length + F.col("_ahead")).otherwise(F.col("ahead")).alias("ahead"), (F.col("low") != F.col("_low")).alias("open")),
            "seen",
        )
        scratch.drop(saved)
        saved = new
        # a dart's stretch and the next tell the same least everywhere: jumps of that length go round the cycle, so it is the cycle's
        if new.where("open").isEmpty():
            return new.select("relation", "dart", "low", "ahead")
        seen, length = new.drop("open"), 2 * length


def assemble(members: DataFrame) -> DataFrame:
    """(relation, ring, no, way, forward) of member ways (relation, way, a, b) from point a to point b.

    A ring is called by its least way, begins with it and runs the way that it does; ``no`` counts
    from 0. A relation with a point where not just two ends meet is broken and has no row.
    A way whose ends are one point is a ring. Repeated members count once.
    """
    scratch = Scratch(members.sparkSession, "rings")
    all_ = cycles(_darts(members, scratch), scratch).where("low % 2 = 0")
    size = all_.groupBy("relation", "low").agg(F.count("*").alias("n"))
    half = lambda c: F.expr(f"{c} div 2")
    out = all_.join(size, ["relation", "low"]).select("relation", half("low").alias("ring"), ((F.col("n") - F.col("ahead")) % F.col("n")).alias("no"), half("dart").alias("way"), (F.col("dart") % 2 == 0).alias("forward"))
    return out


def replaced(members: DataFrame, rings: DataFrame) -> DataFrame:
    """(way) that stand for nothing of their own: outer members (role outer or none) of relations that have rings."""
    outer = members.where(F.coalesce("role", F.lit("")).isin("outer", ""))
    return outer.join(rings.select("relation").distinct(), "relation", "left_semi").select("way").distinct()
