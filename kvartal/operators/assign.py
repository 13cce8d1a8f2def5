"""Places for people: gravity choice under capacities, household composition, calibration."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions import rng
from kvartal.scratch import Scratch

def gravity(people: DataFrame, places: DataFrame, pull: DataFrame, seed: int, rounds: int | None = None) -> DataFrame:
    """(person, place, round) by rounds of parallel proposals with ranked acceptance.

    ``people`` (person, block), ``places`` (place, seats), ``pull`` (block, place, w integer
    weights). In each round every person without a place draws one by weight and seats left among
    places of their block; a place takes the first by a random key until it is full. Rounds go on
    until no waiting person has a place in reach with seats left, or to ``rounds``. People left
    over have a null place and round.
    Results depend on draws only, not on partitions; capacities are never exceeded. It is not
    the person-by-person draw, which is sequential: same invariants, another sample.
    """
    scratch = Scratch(people.sparkSession, "gravity")
    key = rng.stream_key(seed, rng.PLACES)
    seats = scratch.save(places.select("place", "seats").where("seats > 0"), "seats")
    waiting = scratch.save(people.select("person", "block"), "waiting")
    done = None
    all_seats = seats.withColumnRenamed("seats", "all")
    for k in itertools.count() if rounds is None else range(rounds):
        # the share of its seats that a place has left, in 2^10 steps, scales its weight
        left = F.greatest(F.lit(1), F.floor(F.col("seats") * 1024 / F.col("all"))).cast("long")
        open_ = pull.where("w > 0").join(seats.join(all_seats, "place"), "place").select("block", "place", (F.col("w") * left).alias("w"))
        rows = open_.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("c"), F.sum("w").alias("total"))
        draw = rng.philox(waiting, key, [F.col("person"), F.lit(k), F.lit(0), F.lit(2)], ["r0", "r1", "r2", "r3"])
        # 31 bits of the draw times the total, in two parts that fit a long
        bits, low = F.shiftright("r0", 1), F.lit((1 << 31) - 1)
        goal = bits * F.shiftright("total", 31) + F.shiftright(bits * F.col("total").bitwiseAND(low), 31)
        pick = F.aggregate(
            "c",
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("place")),
            lambda a, x: F.struct((a["sum"] + x.w).alias("sum"), F.coalesce(a.place, F.when(a["sum"] + x.w > F.col("goal"), x.place)).alias("place")),
            lambda a: a.place,
        )
        asked = draw.join(rows, "block").withColumn("goal", goal).select("person", "block", pick.alias("place"), "r1")
        order = F.row_number().over(W.Window.partitionBy("place").orderBy("r1", "person"))
        got = scratch.save(asked.join(seats, "place").withColumn("n", order).where(F.col("n") <= F.col("seats")).select("person", "place", F.lit(k).alias("round")), "got")
        done = got if done is None else done.unionByName(got)
        taken = got.groupBy("place").agg(F.count("*").alias("t"))
        seats = scratch.save(seats.join(taken, "place", "left").select("place", (F.col("seats") - F.coalesce("t", F.lit(0))).alias("seats")).where("seats > 0"), "seats")
        waiting = scratch.save(waiting.join(got.select("person"), "person", "left_anti"), "waiting")
        # who has an open place in reach asks, and a place that is asked takes someone
        if got.isEmpty() or seats.isEmpty() or waiting.isEmpty():
            break
    none = waiting.select("person", F.lit(None).cast(seats.schema["place"].dataType).alias("place"), F.lit(None).cast("int").alias("round"))
    return none if done is None else done.unionByName(none)


def compose(homes: DataFrame, seed: int) -> DataFrame:
    """(home, no, age, role) members of households (home, size): a head, mostly a partner, children younger by a generation.

    Every member has the words of two blocks, and the head one, by (home, member, block) only, so
    what is drawn is columns; which words count depends on what others say.
    """
    key = rng.stream_key(seed, rng.POPULATION)
    rows = homes.where("size > 0").select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1)).alias("no"))
    rows = rng.philox(rows, key, [F.col("home"), F.lit(0), F.lit(0), F.lit(4)], ["h0", "h1", "h2", "h3"])
    rows = rng.philox(rows, key, [F.col("home"), F.col("no"), F.lit(1), F.lit(4)], ["a0", "a1", "a2", "a3"])
    rows = rng.philox(rows, key, [F.col("home"), F.col("no"), F.lit(2), F.lit(4)], ["b0", "b1", "b2", "b3"])
    draw = lambda word, n: rng.scaled(F.col(word), n)
    head, no = 22 + draw("h0", 60), F.col("no")
    role = F.when(no == 0, "head").when((no == 1) & (draw("a0", 4) < 3), "partner").when((head < 65) & (draw("a2", 5) < 4), "child").otherwise("other")
    age = F.when(F.col("role") == "head", head).when(F.col("role") == "partner", F.greatest(F.lit(18), head - 5 + draw("a1", 11))).when(F.col("role") == "child", F.greatest(F.lit(0), F.least(head - 18, draw("a3", 24)))).otherwise(18 + draw("b0", 70))
    return rows.withColumn("role", role).select("home", "no", age.alias("age"), "role")


def calibrate(have: DataFrame, want: DataFrame, rounds: int = 8) -> DataFrame:
    """(row, col, f) factors that fit a table of counts (row, col, n) to margins (axis, key, total).

    Iterative proportional fitting over the grouped counts: each half-round is one grouped sum and a join.
    """
    cur = have.groupBy("row", "col").agg(F.sum("n").cast("double").alias("n"))
    base = cur.withColumnRenamed("n", "n0")
    scratch = Scratch(have.sparkSession, "calibrate")
    for _ in range(rounds):
        for axis in ("row", "col"):
            goal = want.where(F.col("axis") == axis).select(F.col("key").alias(axis), "total")
            sums = cur.groupBy(axis).agg(F.sum("n").alias("s")).join(goal, axis)
            cur = cur.join(sums, axis, "left").select("row", "col", (F.col("n") * F.coalesce(F.try_divide(F.col("total"), F.col("s")), F.lit(1.0))).alias("n"))
        cur = scratch.save(cur, "round")
    return cur.join(base, ["row", "col"]).select("row", "col", F.try_divide("n", "n0").alias("f"))


def pair_platforms(members: DataFrame, order: list[str]) -> DataFrame:
    """(route, stop, platform) of route members (route, kind, id and the columns of ``order``).

    A stop takes the first platform between it and the next stop, null if there is none; each
    platform serves once. Among stops and platforms alone that is whatever comes next, so one
    window does what a walk along the route would.
    """
    w = W.Window.partitionBy("route").orderBy(*order)
    rows = members.where(F.col("kind").isin("stop", "platform")).withColumns({"_k": F.lead("kind").over(w), "_i": F.lead("id").over(w)})
    return rows.where("kind = 'stop'").select("route", F.col("id").alias("stop"), F.when(F.col("_k") == "platform", F.col("_i")).alias("platform"))


def _one_place(a: str, b: str, near: float, near_same_name: float) -> Column:
    """Are two members one place, by distance and name?"""
    gap = {c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in "xy"}
    d2 = gap["x"] * gap["x"] + gap["y"] * gap["y"]
    same = (F.col(f"{a}.name") != "") & (F.col(f"{a}.name") == F.col(f"{b}.name"))
    return F.coalesce((d2 < near * near) | (same & (d2 < near_same_name * near_same_name)), F.lit(False))


def _merge_lists(rows: DataFrame, near: float, near_same_name: float) -> DataFrame:
    """(route, place, id, alias) of routes that list all of one kind before all of the other."""
    at = F.row_number().over(W.Window.partitionBy("route", "kind").orderBy("no", "id"))
    sizes = rows.groupBy("route").agg((F.count_if(F.col("kind") == "platform") > F.count_if(F.col("kind") == "stop")).alias("turned"))
    sided = rows.withColumn("at", at).join(sizes, "route").withColumn("leads", (F.col("kind") == "stop") != F.col("turned"))
    lead, rest = sided.where("leads").alias("l"), sided.where("NOT leads").alias("r")
    # which of the leading list each of the other could join, in order
    hits = rest.join(lead, F.col("l.route") == F.col("r.route")).where(_one_place("l", "r", near, near_same_name)).groupBy("r.route", "r.at").agg(F.array_sort(F.collect_list("l.at")).alias("hits"))
    others = rest.select("route", "at", "id").join(hits, ["route", "at"], "left").groupBy("route").agg(F.array_sort(F.collect_list(F.struct("at", "id", "hits"))).alias("rest"))
    # the first that is behind the last one joined: one fold over a route's list
    kind = "array<struct<id:long,joined:int,last:int>>"

    def step(s: Column, m: Column) -> Column:
        hit = F.get(F.filter(m.hits, lambda k: k > s.last), F.lit(0))
        last = F.coalesce(hit, s.last)
        return F.struct(last.alias("last"), F.concat(s.out, F.array(F.struct(m.id.cast("long").alias("id"), hit.cast("int").alias("joined"), last.cast("int").alias("last")))).cast(kind).alias("out"))

    start = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("out"))
    chosen = others.select("route", F.explode(F.aggregate("rest", start, step, lambda s: s.out)).alias("m")).select("route", "m.id", "m.joined", "m.last")
    some = chosen.groupBy("route").agg(F.count_if(F.col("joined").isNotNull()).alias("pairs"))
    aliases = chosen.where("joined IS NOT NULL").select("route", F.col("joined").alias("at"), F.col("id").alias("alias"))
    base = sided.where("leads").join(aliases, ["route", "at"], "left").select("route", F.col("id").cast("long").alias("id"), "alias", F.col("at").alias("after"), F.lit(0).alias("own"), "no")
    alone = rest.select("route", "no", "at", F.col("id").cast("long").alias("id")).join(chosen.where("joined IS NULL").select("route", "id", "last"), ["route", "id"])
    alone = alone.select("route", "id", F.lit(None).cast("long").alias("alias"), F.col("last").alias("after"), F.col("at").alias("own"), "no")
    both = base.unionByName(alone).join(some, "route")
    # without a pair the order stays as it was
    met = F.col("pairs") > 0
    order = W.Window.partitionBy("route").orderBy(F.when(met, F.col("after")), F.when(met, F.col("own")), "no", "id")
    return both.select("route", (F.row_number().over(order) - 1).cast("long").alias("place"), "id", "alias")


def merge_stops(members: DataFrame, near: float, near_same_name: float) -> DataFrame:
    """(route, place, id, alias) of route members (route, no, kind, id, x, y, name): stops and platforms in route order.

    A stop and a platform are one if they are nearer than ``near``, or than ``near_same_name``
    and of one name; the stop stands for both and the platform is its alias. Neighbours pair,
    in either order, from the route's begin on. A route that lists all of one kind before
    all of the other holds two parallel lists: the longer (stops if equal) keeps its order,
    each of the other list joins the first of it that is near and behind the last one joined,
    and those that find none follow that one. Without any pair the order stays.
    """
    rows = members.where(F.col("kind").isin("stop", "platform"))
    w = W.Window.partitionBy("route").orderBy("no", "id")
    last = F.lag("kind").over(w)
    rows = rows.withColumn("_turn", F.coalesce(last != F.col("kind"), F.lit(False)).cast("int"))
    shape = rows.groupBy("route").agg(F.sum("_turn").alias("_turns")).where("_turns = 1").select("route")
    rows = rows.drop("_turn")
    lists = rows.join(shape, "route", "left_semi")
    walked = rows.join(shape, "route", "left_anti")

    two = _merge_lists(lists, near, near_same_name)
    nxt = lambda c: F.lead(c).over(w)
    d2 = (F.col("x") - nxt("x")) * (F.col("x") - nxt("x")) + (F.col("y") - nxt("y")) * (F.col("y") - nxt("y"))
    same = (F.col("name") != "") & (F.col("name") == nxt("name"))
    link = (F.col("kind") != nxt("kind")) & ((d2 < near * near) | (same & (d2 < near_same_name * near_same_name)))
    rows = walked.withColumns({"_link": F.coalesce(link, F.lit(False)), "_next": nxt("id"), "_n": F.row_number().over(w)})
    # in a run of links every other one is taken, the first first
    since = F.max(F.when(~F.col("_link"), F.col("_n"))).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    rows = rows.withColumn("_taken", F.col("_link") & ((F.col("_n") - F.coalesce(since, F.lit(0))) % 2 == 1))
    rows = rows.withColumn("_second", F.coalesce(F.lag("_taken").over(w), F.lit(False))).where("NOT _second")
    first_is_stop = F.col("kind") == "stop"
    id_ = F.when(F.col("_taken") & ~first_is_stop, F.col("_next")).otherwise(F.col("id"))
    alias = F.when(F.col("_taken"), F.when(first_is_stop, F.col("_next")).otherwise(F.col("id")))
    one = rows.select("route", (F.row_number().over(w) - 1).cast("long").alias("place"), id_.cast("long").alias("id"), alias.cast("long").alias("alias"))
    return one.unionByName(two)
