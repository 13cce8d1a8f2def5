"""Event-time operators: last write wins, queues, boarding, state as of a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one aggregate, combined map-side, instead of a window."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*by).agg(best.alias("_r")).select(*by, *(F.col("_r")[c].alias(c) for c in rest))


def state_asof(changes: DataFrame, by: str, time: str, at: int, ties: list[str]) -> DataFrame:
    """Last change of each key at or before ``at``."""
    return latest(changes.where(F.col(time) <= at), [by], [time, *ties])


def last_n(df: DataFrame, by: str, order: list[Column], n: int, rank: str = "back") -> DataFrame:
    """The last n rows of each key, numbered backwards from 1: a ring buffer."""
    w = W.Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def boarding_with_limit(arrivals: DataFrame, vehicles: DataFrame, stop: str, limit: int) -> DataFrame:
    """The same where those who have waited longer than ``limit`` leave the queue before the next vehicle.

    Returns stop, id, rank, k (null: gave up, or nobody came within the limit). Persons are
    counted by vehicle first; only a stop's vehicles are walked through in order: the queue's
    head is behind those who boarded and those who left.
    """
    w = W.Window.partitionBy(stop)
    ranked = arrivals.withColumn("rank", F.row_number().over(w.orderBy("t", "id")).cast("long"))
    here = arrivals.groupBy(stop, "t").agg(F.count("*").alias("n"))
    ends = lambda at: vehicles.select(stop, at.alias("t"), "k", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"))

    def upto(at: Column, name: str, before: bool) -> DataFrame:
        # arrivals at the same time count unless only those before it are asked for
        both = here.select(stop, "t", F.lit(None).cast("long").alias("k"), F.lit(2 if before else 0).alias("kind"), "n").unionByName(ends(at))
        seen = both.withColumn(name, F.sum("n").over(w.orderBy("t", "kind").rangeBetween(W.Window.unboundedPreceding, 0)))
        return seen.where("kind = 1").select(stop, "k", name)

    each = upto(F.col("depart"), "came", False).join(upto(F.col("depart") - limit, "left", True), [stop, "k"]).join(vehicles.select(stop, "k", "seats"), [stop, "k"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        head, lo, hi = 0, [], []
        for came, left, seats in zip(pdf["came"], pdf["left"], pdf["seats"]):
            start = max(head, left)
            head = max(start, min(came, start + seats))
            lo.append(start + 1), hi.append(head)
        return pd.DataFrame({stop: pdf[stop], "k": pdf["k"], "lo": lo, "hi": hi})

    kind = arrivals.schema[stop].dataType.simpleString()
    taken = each.groupBy(stop).applyInPandas(walk, f"{stop} {kind}, k long, lo long, hi long").where("lo <= hi")
    taken = taken.select(F.col(stop).alias("_s"), "k", F.explode(F.sequence("lo", "hi")).alias("_r"))
    return ranked.join(taken, (F.col(stop) == F.col("_s")) & (F.col("rank") == F.col("_r")), "left").select(stop, "id", "rank", "k")


def boarding(arrivals: DataFrame, vehicles: DataFrame, stop: str) -> DataFrame:
    """Who boards which vehicle of a stop, first come first served, in closed form.

    ``arrivals``: stop, t, id. ``vehicles``: stop, k (from 0 without gaps), depart, seats.
    With S the seats and A the arrivals up to vehicle k, boardings up to it are
    S + min(0, min over j <= k of A - S); rank r boards the first k where they reach r.
    Returns stop, id, rank, k (null: nobody took them). No loop: two running windows.
    """
    w = W.Window.partitionBy(stop)
    ranked = arrivals.withColumn("rank", F.row_number().over(w.orderBy("t", "id")).cast("long"))
    # arrivals before each departure: both streams in one time order, arrivals first
    both = arrivals.select(stop, "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k"), F.lit(0).cast("long").alias("seats"))
    both = both.unionByName(vehicles.select(stop, F.col("depart").alias("t"), F.lit(1).alias("kind"), F.col("k").cast("long").alias("k"), F.col("seats").cast("long").alias("seats")))
    seen = both.withColumn("a", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w.orderBy("t", "kind")))
    runs = seen.where("kind = 1").withColumn("s", F.sum("seats").over(w.orderBy("k")))
    slack = F.min(F.col("a") - F.col("s")).over(w.orderBy("k"))
    up = runs.withColumn("b", (F.col("s") + F.least(F.lit(0), slack)).cast("long"))
    upto = up.withColumn("from_rank", F.coalesce(F.lag("b").over(w.orderBy("k")), F.lit(0)) + 1).where("b >= from_rank")
    taken = upto.select(F.col(stop).alias("_s"), "k", F.explode(F.sequence("from_rank", "b")).alias("_r"))
    return ranked.join(taken, (F.col(stop) == F.col("_s")) & (F.col("rank") == F.col("_r")), "left").select(stop, "id", "rank", "k")
