"""Draws, households, roles, schedules, graphs and transit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions import rng
from kvartal.operators import graph
from kvartal.plans.registry import query
from kvartal.sources.tables import read

SEED = 20240101
POP, SCHED, TRANSIT = (rng.stream_key(SEED, s) for s in (rng.POPULATION, rng.SCHEDULES, rng.TRANSIT))
_ORD = rng.sql_words(POP, ["o_orderkey", "1", "0", "1"], "orders", "o_orderkey")
_CUS = rng.sql_words(SCHED, ["c_custkey", "2", "0", "1"], "customer", "c_custkey, c_nationkey")


def _orders(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    return rng.philox(o, POP, [F.col("o_orderkey"), F.lit(1), F.lit(0), F.lit(1)], ["r0", "r1", "r2", "r3"])


def _customers(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return rng.philox(c, SCHED, [F.col("c_custkey"), F.lit(2), F.lit(0), F.lit(1)], ["r0", "r1", "r2", "r3"])


@query("philox_draw", _ORD)
def philox_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four random words for each order, the same on any cluster."""
    return _orders(spark, sf_dir)


@query("chance_filter", f"SELECT o_orderkey FROM ({_ORD}) WHERE r0 < {rng.threshold(0.125)}")
def chance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(rng.chance(F.col("r0"), 0.125)).select("o_orderkey")


SHARES = [0.1, 0.2, 0.3, 0.4]


@query("categorical_pick", f"SELECT o_orderkey, CASE WHEN r1 < {rng.threshold(0.1)} THEN 0 WHEN r1 < {rng.threshold(0.1 + 0.2)} THEN 1 WHEN r1 < {rng.threshold(0.1 + 0.2 + 0.3)} THEN 2 ELSE 3 END AS pick FROM ({_ORD})")
def categorical_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", rng.categorical(F.col("r1"), SHARES).alias("pick"))


@query("lemire_below", f"SELECT o_orderkey, CASE WHEN (r0 * 1000003) & 4294967295 >= {(1 << 32) % 1000003} THEN (r0 * 1000003) >> 32 WHEN (r1 * 1000003) & 4294967295 >= {(1 << 32) % 1000003} THEN (r1 * 1000003) >> 32 WHEN (r2 * 1000003) & 4294967295 >= {(1 << 32) % 1000003} THEN (r2 * 1000003) >> 32 END AS pick FROM ({_ORD})")
def lemire_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even draws below a million and three."""
    return _orders(spark, sf_dir).select("o_orderkey", rng.below([F.col("r0"), F.col("r1"), F.col("r2")], 1_000_003).alias("pick"))


@query(
    "household_sizes",
    f"""WITH h AS (SELECT c_custkey AS home, 2 + c_custkey % 9 AS residents FROM customer), s AS (SELECT home, residents, unnest(range(0, residents)) AS no FROM h),
    d AS ({rng.sql_words(POP, ["home", "3", "no", "1"], "s", "home, residents, no")}),
    z AS (SELECT *, 1 + ((r0 * 5) >> 32) AS size FROM d), c AS (SELECT *, sum(size) OVER (PARTITION BY home ORDER BY no) - size AS before FROM z)
    SELECT home, no, CAST(least(size, residents - before) AS BIGINT) AS size FROM c WHERE before < residents""",
)
def household_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Households of drawn sizes until a building's residents are used up; the last is cut."""
    h = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("home"), (2 + F.col("c_custkey") % 9).alias("residents"))
    s = h.select("home", "residents", F.explode(F.sequence(F.lit(0).cast("long"), F.col("residents") - 1)).alias("no"))
    d = rng.philox(s, POP, [F.col("home"), F.lit(3), F.col("no"), F.lit(1)], ["r0", "r1", "r2", "r3"]).withColumn("size", 1 + rng.scaled(F.col("r0"), 5))
    before = F.sum("size").over(W.Window.partitionBy("home").orderBy("no")) - F.col("size")
    return d.withColumn("before", before).where("before < residents").select("home", "no", F.least("size", F.col("residents") - F.col("before")).alias("size"))


@query("age_weights", "SELECT p_brand, age, CAST(sum(n * 1000 // w) AS BIGINT) AS weight FROM (SELECT p_brand, count(*) AS n, 1 + p_size % 5 AS w, unnest(range(CAST(p_size AS BIGINT), p_size + 1 + p_size % 5)) AS age FROM part GROUP BY p_brand, p_size) GROUP BY p_brand, age")
def age_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of age bands spread over their years."""
    w = 1 + F.col("p_size") % 5
    band = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    year = band.select("p_brand", ((F.col("n") * 1000 - (F.col("n") * 1000) % w) / w).cast("long").alias("m"), F.explode(F.sequence(F.col("p_size").cast("long"), (F.col("p_size") + w - 1).cast("long"))).alias("age"))
    return year.groupBy("p_brand", "age").agg(F.sum("m").alias("weight"))


@query("role_pick", f"SELECT c_custkey, CASE WHEN r0 % 90 < 7 THEN 'preschool' WHEN r0 % 90 < 18 THEN 'school' WHEN r0 % 90 < 65 AND r1 < {rng.threshold(0.7)} THEN 'work' ELSE 'none' END AS role FROM ({_CUS})")
def role_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.col("r0") % 90
    role = F.when(age < 7, "preschool").when(age < 18, "school").when((age < 65) & rng.chance(F.col("r1"), 0.7), "work").otherwise("none")
    return _customers(spark, sf_dir).select("c_custkey", role.alias("role"))


#: Sizes of the five codes that a profile packs, the first the most significant.
PROFILE = (4, 3, 3, 4, 4)


@query("profile_codes", f"SELECT c_custkey, code, code // 144 AS a, code // 48 % 3 AS b, code // 16 % 3 AS c, code // 4 % 4 AS d, code % 4 AS e FROM (SELECT c_custkey, (((r0 * 4 >> 32) * 3 + (r1 * 3 >> 32)) * 3 + (r2 * 3 >> 32)) * 16 + (r3 * 16 >> 32) AS code FROM ({_CUS}))")
def profile_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five codes packed in mixed radix and taken apart again."""
    draws = [rng.scaled(F.col("r0"), 4), rng.scaled(F.col("r1"), 3), rng.scaled(F.col("r2"), 3), rng.scaled(F.col("r3"), 16)]
    code = draws[0]
    for d, n in zip(draws[1:], (3, 3, 16)):
        code = code * n + d
    out, left = [], F.col("code")
    for name, n in zip("edcba", reversed(PROFILE)):
        out.append((left % n).alias(name))
        left = (left - left % n) / n
        left = left.cast("long")
    return _customers(spark, sf_dir).select("c_custkey", code.alias("code")).select("c_custkey", "code", *out)


@query("personal_times", f"SELECT c_custkey, 7 * 3600 + ((r0 * 7200) >> 32) AS out_s, 16 * 3600 + ((r1 * 10800) >> 32) AS back_s, r2 % 4 AS phase FROM ({_CUS})")
def personal_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _customers(spark, sf_dir)
    return c.select("c_custkey", (7 * 3600 + rng.scaled(F.col("r0"), 7200)).alias("out_s"), (16 * 3600 + rng.scaled(F.col("r1"), 10800)).alias("back_s"), (F.col("r2") % 4).alias("phase"))


_DAYS = f"p AS (SELECT c_custkey, 7 * 3600 + ((r0 * 7200) >> 32) AS out_s, 16 * 3600 + ((r1 * 10800) >> 32) AS back_s, r2 % 4 AS phase FROM ({_CUS})), w AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN (d + phase) % 4 < 2 ELSE d % 7 < 5 END AS works FROM p, range(0, 14) t(d))"


@query("work_days", f"WITH {_DAYS} SELECT c_custkey, d AS day FROM w WHERE works")
def work_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays, or two days on and two off."""
    day = personal_times(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(13).cast("long"))).alias("day"))
    works = F.when(F.col("c_custkey") % 3 == 0, (F.col("day") + F.col("phase")) % 4 < 2).otherwise(F.col("day") % 7 < 5)
    return day.where(works).select("c_custkey", "day")


@query("trip_requests", f"WITH {_DAYS}, r AS (SELECT c_custkey, d * 86400 + out_s AS t, 'there' AS way FROM w WHERE works UNION ALL SELECT c_custkey, d * 86400 + back_s, 'back' FROM w WHERE works) SELECT c_custkey, t, way, lead(t) OVER (PARTITION BY c_custkey ORDER BY t) AS next_t FROM r")
def trip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trips of each working day, and when the next one is due."""
    r = work_days(spark, sf_dir).join(personal_times(spark, sf_dir), "c_custkey")
    base = F.col("day") * 86400
    ways = F.array(F.struct((base + F.col("out_s")).alias("t"), F.lit("there").alias("way")), F.struct((base + F.col("back_s")).alias("t"), F.lit("back").alias("way")))
    each = r.select("c_custkey", F.explode(ways).alias("x")).select("c_custkey", "x.t", "x.way")
    return each.withColumn("next_t", F.lead("t").over(W.Window.partitionBy("c_custkey").orderBy("t")))


@query("components_weak", "WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, s_suppkey + s_nationkey + 1 AS b FROM supplier WHERE s_suppkey + s_nationkey + 1 <= (SELECT max(s_suppkey) FROM supplier) AND s_nationkey < 12), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT s_suppkey AS id, s_suppkey AS r FROM supplier UNION SELECT w.id, x.b FROM w JOIN x ON w.r = x.a) SELECT id, min(r) AS component FROM w GROUP BY id")
def components_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    e = s.where("s_nationkey < 12").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + F.col("s_nationkey") + 1).alias("b"))
    e = e.join(s.select(F.col("s_suppkey").alias("b")), "b")
    return graph.weak_components(s.select(F.col("s_suppkey").alias("id")), e)


_ARCS = "a AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, 10 + n_nationkey % 6 AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25, 30 + n_regionkey FROM nation WHERE n_nationkey % 3 <> 0)"


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("long")
    one = n.select(k.alias("src"), ((k * 7 + 3) % 25).alias("dst"), (10 + k % 6).alias("w"))
    return one.unionAll(n.where("n_nationkey % 3 <> 0").select(k, (k + 5) % 25, (30 + F.col("n_regionkey")).cast("long")))


@query("components_strong", f"WITH RECURSIVE {_ARCS}, r AS (SELECT src AS x, dst AS y FROM a UNION SELECT r.x, a.dst FROM r JOIN a ON r.y = a.src) SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(least(n_nationkey, coalesce((SELECT min(p.y) FROM r p JOIN r q ON p.x = q.y AND p.y = q.x WHERE p.x = n_nationkey), n_nationkey)) AS BIGINT) AS component FROM nation")
def components_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _arcs(spark, sf_dir)
    return graph.strong_components(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), a.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("shortest_time", f"WITH RECURSIVE {_ARCS}, d AS (SELECT CAST(n_nationkey AS BIGINT) AS origin, CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS time, 0 AS hops FROM nation UNION SELECT d.origin, a.dst, d.time + a.w, hops + 1 FROM d JOIN a ON a.src = d.node WHERE a.src <> a.dst AND hops < 24) SELECT origin, node, min(time) AS time FROM d GROUP BY origin, node")
def shortest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All times between nations, an origin a search."""
    return graph.shortest_times(_arcs(spark, sf_dir), read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")))


_TRIPS = "t AS (SELECT o_orderkey, o_custkey % 10 AS route, o_orderkey % 12 AS b, o_orderkey % 12 + 1 + o_custkey % 5 AS e, CAST(round(o_totalprice) AS BIGINT) % 5000 AS walk_s, o_orderkey % 4 = 0 AS car FROM orders)"


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("o_orderkey") % 12
    return read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("route"), b.alias("b"), (b + 1 + F.col("o_custkey") % 5).alias("e"), (F.round("o_totalprice").cast("long") % 5000).alias("walk_s"), (F.col("o_orderkey") % 4 == 0).alias("car"))


@query("mode_choice", f"WITH {_TRIPS} SELECT o_orderkey, CASE WHEN car THEN 'car' WHEN walk_s <= 2400 AND walk_s <= 900 + (e - b) * 180 THEN 'walk' WHEN route <> 0 THEN 'transit' WHEN walk_s <= 4800 THEN 'walk' ELSE 'none' END AS mode FROM t")
def mode_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    transit = 900 + (F.col("e") - F.col("b")) * 180
    mode = F.when(F.col("car"), "car").when((F.col("walk_s") <= 2400) & (F.col("walk_s") <= transit), "walk").when(F.col("route") != 0, "transit").when(F.col("walk_s") <= 4800, "walk").otherwise("none")
    return _trips(spark, sf_dir).select("o_orderkey", mode.alias("mode"))


_LOAD = f"{_TRIPS}, l AS (SELECT route, pos, count(*) AS load FROM (SELECT route, unnest(range(b, e)) AS pos FROM t) GROUP BY ALL)"


@query("segment_load", f"WITH {_LOAD} SELECT * FROM l")
def segment_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Riders on each segment: comings and goings summed first, so that long rides do not multiply rows."""
    t = _trips(spark, sf_dir)
    steps = t.select("route", F.explode(F.array(F.struct(F.col("b").alias("pos"), F.lit(1).alias("n")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("n")))).alias("d")).groupBy("route", "d.pos").agg(F.sum("d.n").alias("n"))
    w = W.Window.partitionBy("route").orderBy("pos")
    runs = steps.withColumn("load", F.sum("n").over(w)).withColumn("upto", F.lead("pos").over(w)).where("load > 0")
    return runs.select("route", F.explode(F.sequence("pos", F.col("upto") - 1)).alias("pos"), "load")


CAP = 60


@query("crowding_share", f"WITH {_LOAD} SELECT route, CAST(sum(greatest(load - {CAP}, 0)) * 10000 // sum(load) AS BIGINT) AS over_bp, CAST(max(load) * 10000 // {CAP} AS BIGINT) AS most_bp FROM l GROUP BY route")
def crowding_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, all_ = F.sum(F.greatest(F.col("load") - CAP, F.lit(0))), F.sum("load")
    return segment_load(spark, sf_dir).groupBy("route").agg(F.floor(over * 10000 / all_).cast("long").alias("over_bp"), F.floor(F.max("load") * 10000 / F.lit(CAP)).cast("long").alias("most_bp"))


@query("demand_headway", f"WITH {_LOAD} SELECT route, CAST(least(900, greatest(90, {CAP} * 8000 * 3600 // (10000 * max(load)))) AS BIGINT) AS headway FROM l GROUP BY route")
def demand_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headway that the busiest segment needs, within bounds."""
    need = F.floor(F.lit(CAP * 8000 * 3600) / (10000 * F.max("load")))
    return segment_load(spark, sf_dir).groupBy("route").agg(F.least(F.lit(900), F.greatest(F.lit(90), need)).cast("long").alias("headway"))


@query("run_schedule", "SELECT s_suppkey AS route, p AS period, dep FROM (SELECT s_suppkey, p, unnest(range(p * 14400 + s_suppkey * 37 % (300 + 60 * p), (p + 1) * 14400, 300 + 60 * p)) AS dep FROM supplier, range(0, 6) t(p))")
def run_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures of each route and period."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("p"))
    step = 300 + 60 * F.col("p")
    return s.select(F.col("s_suppkey").alias("route"), F.col("p").alias("period"), F.explode(F.sequence(F.col("p") * 14400 + F.col("s_suppkey") * 37 % step, (F.col("p") + 1) * 14400 - 1, step)).alias("dep"))


@query("run_numbering", "SELECT o_custkey AS route, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderdate, o_custkey, o_orderkey) - 1 AS no FROM orders")
def run_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a day's runs in order of departure and route."""
    w = W.Window.partitionBy("day").orderBy("o_orderdate", "o_custkey", "o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.select(F.col("o_custkey").alias("route"), "o_orderkey", "day", (F.row_number().over(w) - 1).cast("long").alias("no"))
