"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step
is a grouped minimum (combined map-side) and an equi-join, so no group of links is
gathered in one task; the links of each round replace the last round's on shared disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.scratch import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) links -> (node long, component long): the least node reachable.

    Only nodes with a link to another node have a row. Self links, repeated links and
    links with a null end are ignored.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    cur = scratch.save(e.distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # minima are written before they are joined: beside a fresh aggregate the links of a hub could not be split
        around = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "least")
        large = both.join(around, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        large = scratch.save(large.distinct(), "large")
        # of large-star every a exceeds its b: small-star hangs a and its b on a's least b
        least = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        own, other = F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.join(least, "a").select(F.explode(F.array(own, other)).alias("x")).select("x.a", "x.b").where(F.col("a") != F.col("b")).distinct()
        new = scratch.save(small, "links")
        for old in (cur, around, large, least):
            scratch.drop(old)
        cur = new
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
