"""Nearest, radius, as-of, containment, allocation and sampling queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions.rounding import cents
from kvartal.operators import alloc, forest, grid, rings, shapes
from kvartal.plans.registry import query
from kvartal.sources.tables import read

_SX = "SELECT s_suppkey AS a_id, CAST(round(s_acctbal * 100) AS BIGINT) AS ax, CAST(s_nationkey AS BIGINT) * 1000 AS ay FROM supplier"
_CX = "SELECT c_custkey AS b_id, CAST(round(c_acctbal * 100) AS BIGINT) AS bx, CAST(c_nationkey AS BIGINT) * 1000 AS yb FROM customer"
#: Starts of the periods of a day in seconds; before the first it is still the last.
PERIODS = (6 * 3600, 7 * 3600, 10 * 3600, 16 * 3600, 20 * 3600, 23 * 3600)
POLYGON = [(0, 0), (90000, 10000), (60000, 40000), (80000, 80000), (20000, 86399), (30000, 50000)]


def _points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    a = s.select(F.col("s_suppkey").alias("a_id"), cents(F.col("s_acctbal")).alias("ax"), (F.col("s_nationkey").cast("long") * 1000).alias("ay"))
    b = c.select(F.col("c_custkey").alias("b_id"), cents(F.col("c_acctbal")).alias("bx"), (F.col("c_nationkey").cast("long") * 1000).alias("by"))
    return a, b


@query("nearest_one_tie", f"SELECT a_id, b_id, d2 FROM (SELECT a_id, b_id, d2, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS r FROM (SELECT a_id, b_id, (ax - bx) * (ax - bx) + (ay - yb) * (ay - yb) AS d2 FROM ({_SX}) CROSS JOIN ({_CX}))) WHERE r = 1")
def nearest_one_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all, ties to the least id."""
    return grid.nearest_any(*_points(spark, sf_dir))


@query("nearest_k_limit", f"SELECT a_id, CAST(r AS INTEGER) AS rank, b_id, d2 FROM (SELECT a_id, b_id, d2, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS r FROM (SELECT a_id, b_id, (ax - bx) * (ax - bx) + (ay - yb) * (ay - yb) AS d2 FROM ({_SX}) CROSS JOIN ({_CX})) WHERE d2 <= 25000::BIGINT * 25000) WHERE r <= 8")
def nearest_k_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest within a radius, by (distance, id)."""
    return grid.nearest(*_points(spark, sf_dir), 25_000, 8)


@query("radius_pairs", f"SELECT a_id, b_id, d2 FROM (SELECT a_id, b_id, (ax - bx) * (ax - bx) + (ay - yb) * (ay - yb) AS d2 FROM ({_SX}) CROSS JOIN ({_CX})) WHERE d2 <= 4000::BIGINT * 4000")
def radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a radius."""
    return grid.within(*_points(spark, sf_dir), 4_000)


@query(
    "fallback_snap",
    f"""WITH d AS (SELECT a_id, b_id, b_id % 10 = 0 AS main, (ax - bx) * (ax - bx) + (ay - yb) * (ay - yb) AS d2 FROM ({_SX}) CROSS JOIN ({_CX})),
    m AS (SELECT a_id, arg_min(b_id, (d2, b_id)) AS b_id FROM d WHERE main AND d2 <= 5000::BIGINT * 5000 GROUP BY a_id),
    u AS (SELECT a_id, arg_min(b_id, (d2, b_id)) AS b_id FROM d WHERE d2 <= 40000::BIGINT * 40000 GROUP BY a_id)
    SELECT s_suppkey AS a_id, coalesce(m.b_id, u.b_id) AS b_id, m.b_id IS NOT NULL AS on_main FROM supplier LEFT JOIN m ON m.a_id = s_suppkey LEFT JOIN u ON u.a_id = s_suppkey""",
)
def fallback_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snap to the main part nearby, else to anything further off."""
    a, b = _points(spark, sf_dir)
    main = grid.nearest(a, b.where("b_id % 10 = 0"), 5_000).select("a_id", F.col("b_id").alias("m"))
    rest = a.join(main, "a_id", "left_anti")  # only what found nothing looks further
    any_ = grid.nearest(rest, b, 40_000).select("a_id", F.col("b_id").alias("u"))
    return a.join(main, "a_id", "left").join(any_, "a_id", "left").select("a_id", F.coalesce("m", "u").alias("b_id"), F.col("m").isNotNull().alias("on_main"))


@query(
    "period_asof",
    f"SELECT event_id, CAST(CASE {' '.join(f'WHEN s >= {p} THEN {i}' for i, p in reversed(list(enumerate(PERIODS))))} ELSE {len(PERIODS) - 1} END AS INTEGER) AS period FROM (SELECT event_id, (epoch_us(ts) // 1000000) % 86400 AS s FROM events)",
)
def period_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period of the day at each event; before the first start it is the last, across midnight."""
    s = F.pmod(F.unix_seconds("ts"), F.lit(86400))
    period = F.lit(len(PERIODS) - 1)
    for i, p in enumerate(PERIODS):
        period = F.when(s >= p, i).otherwise(period)
    return read(spark, sf_dir, "events").select("event_id", period.alias("period"))


def _crossings_sql() -> str:
    out = "false"
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        (xa, ya), (xb, yb) = sorted([(x1, y1), (x2, y2)], key=lambda q: q[1])
        out = f"({out} <> (y >= {ya} AND y < {yb} AND (x - {xa}) * {yb - ya} < (y - {ya}) * ({xb - xa})))"
    return out


@query("polygon_winding", f"SELECT event_id, {_crossings_sql()} AS inside FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS x, (epoch_us(ts) // 1000000) % 86400 AS y FROM events)")
def polygon_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a concave polygon, exactly."""
    e = read(spark, sf_dir, "events").select("event_id", cents(F.col("value")).alias("x"), F.pmod(F.unix_seconds("ts"), F.lit(86400)).alias("y"))
    return e.select("event_id", grid.inside(F.col("x"), F.col("y"), POLYGON).alias("inside"))


_R = """r AS (SELECT p_partkey AS id, p_size % 4 AS kind, p_partkey * 7919 % side AS x, p_partkey * 5003 % side AS y, p_partkey % 3 > 0 AS area,
    CAST(10 * [1, 3, 9, 27, 81][1 + p_partkey % 5] AS BIGINT) AS a, CAST(10 * [2, 5, 8, 30, 77][1 + p_partkey % 5] AS BIGINT) AS b, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS name
    FROM part, (SELECT 160 * CAST(floor(sqrt(count(*))) AS BIGINT) + 7 AS side FROM part)),
    p AS (SELECT o.id, arg_max(c.id, (c.a * c.b, c.id)) AS parent FROM r o JOIN r c ON o.kind = c.kind AND c.area AND abs(o.x - c.x) * c.b + abs(o.y - c.y) * c.a <= c.a * c.b
      AND (NOT o.area OR c.a * c.b > o.a * o.b OR c.a * c.b = o.a * o.b AND c.id > o.id) GROUP BY o.id),
    w AS (SELECT id, id AS root FROM r UNION SELECT w.id, p.parent FROM w JOIN p ON w.root = p.id), f AS (SELECT id, root FROM w WHERE root NOT IN (SELECT id FROM p))"""


def _facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of four kinds on a plane that grows with them: points, and rhombi from 10 to 810 wide."""
    part = read(spark, sf_dir, "part")
    side, k = 160 * math.isqrt(part.count()) + 7, F.col("p_partkey")
    pick = lambda *v: (10 * F.get(F.array(*map(F.lit, v)), (k % 5).cast("int"))).cast("long")
    at = part.select(k.alias("id"), (F.col("p_size") % 4).alias("kind"), (k * 7919 % side).alias("x"), (k * 5003 % side).alias("y"), (k % 3 > 0).alias("area"), pick(1, 3, 9, 27, 81).alias("a"), pick(2, 5, 8, 30, 77).alias("b"), F.when(k % 4 == 0, F.col("p_name")).alias("name"))
    x, y, a, b = (F.col(c) for c in "xyab")
    return at.select("id", "kind", "x", "y", F.when(F.col("area"), shapes.ring_of((x - a, y), (x, y - b), (x + a, y), (x, y + b))).alias("ring"), "name")


@query("merge_contained", f"WITH RECURSIVE {_R} SELECT id, root FROM f")
def merge_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records inside larger ones of their kind are these: points in buildings in sites, to the outermost."""
    return forest.contain(_facilities(spark, sf_dir))


@query("facilities_merged", f"WITH RECURSIVE {_R} SELECT root AS id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, coalesce(arg_min(name, (id <> root, id)) FILTER (name IS NOT NULL), '') AS name FROM f JOIN r USING (id) GROUP BY root")
def facilities_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each outermost record with all ids that it stands for and the first name that any of them has."""
    rows = _facilities(spark, sf_dir)
    out = forest.merged(rows, forest.contain(rows))
    return out.select("id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "name")


_M = """o AS (SELECT l_orderkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS no, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    g AS (SELECT r, no, n, CASE WHEN n >= 5 AND no > 2 THEN 3 ELSE 1 END AS first, CASE WHEN n >= 5 AND no <= 2 THEN 2 ELSE n END AS last FROM o),
    s AS (SELECT r, no, r * 1024 + no * 37 % 1024 AS way, r * 1024 + no AS p, r * 1024 + CASE WHEN no = last THEN first ELSE no + 1 END AS q, no % 4 <> 3 AS outer_ FROM g WHERE r % 5 <> 0 OR no <> 2
      UNION ALL SELECT 0, c_custkey, c_custkey * 7919 % 1000000007, c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN (SELECT min(c_custkey) FROM customer) ELSE c_custkey + 1 END, true FROM customer),
    m AS (SELECT r AS relation, no, way, CASE WHEN (r + no) % 3 = 0 THEN q ELSE p END AS a, CASE WHEN (r + no) % 3 = 0 THEN p ELSE q END AS b, outer_ FROM s),
    bad AS (SELECT DISTINCT relation FROM (SELECT relation, a AS x FROM m UNION ALL SELECT relation, b FROM m) GROUP BY relation, x HAVING count(*) <> 2),
    k AS (SELECT * FROM m ANTI JOIN bad USING (relation)), e AS (SELECT relation, way, a AS x, b AS y, true AS forward FROM k UNION ALL SELECT relation, way, b, a, false FROM k),
    w AS (SELECT relation, way AS ring, a AS home, 0::BIGINT AS no, way, true AS forward, b AS x FROM k
      UNION ALL SELECT w.relation, w.ring, w.home, w.no + 1, e.way, e.forward, e.y FROM w JOIN e ON e.relation = w.relation AND e.x = w.x AND e.way <> w.way WHERE e.way > w.ring),
    z AS (SELECT relation, ring, no, way, forward, arg_max(x, no) OVER (PARTITION BY relation, ring) = home AS closed FROM w)"""


def _outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member ways: an order's lines go round in one or two rings, some broken, and all customers in one."""
    by = W.Window.partitionBy("l_orderkey")
    o = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("r"), F.row_number().over(by.orderBy("l_linenumber")).cast("long").alias("no"), F.count("*").over(by).alias("n"))
    r, no, two = F.col("r"), F.col("no"), F.col("n") >= 5
    first, last = F.when(two & (no > 2), 3).otherwise(1), F.when(two & (no <= 2), 2).otherwise(F.col("n"))
    lines = o.where((r % 5 != 0) | (no != 2)).select("r", "no", (r * 1024 + no * 37 % 1024).alias("way"), (r * 1024 + no).alias("p"), (r * 1024 + F.when(no == last, first).otherwise(no + 1)).alias("q"), (no % 4 != 3).alias("outer_"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("no"))
    ends = c.agg(F.min("no").alias("least"), F.max("no").alias("most"))
    ring = c.join(F.broadcast(ends), F.col("no").between(F.col("least"), F.col("most")))
    ring = ring.select(F.lit(0).cast("long").alias("r"), "no", (no * 7919 % 1000000007).alias("way"), no.alias("p"), F.when(no == F.col("most"), F.col("least")).otherwise(no + 1).alias("q"), F.lit(True).alias("outer_"))
    turned = (r + no) % 3 == 0
    all_ = lines.unionByName(ring)
    return all_.select(r.alias("relation"), "no", "way", F.when(turned, F.col("q")).otherwise(F.col("p")).alias("a"), F.when(turned, F.col("p")).otherwise(F.col("q")).alias("b"), F.when(F.col("outer_"), "outer").otherwise("inner").alias("role"))


@query("ring_order", f"WITH RECURSIVE {_M} SELECT relation, ring, no, way, forward FROM z WHERE closed")
def ring_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed rings of member ways, in order from the least way on."""
    return rings.assemble(_outlines(spark, sf_dir))


@query(
    "assembled_outlines",
    f"WITH RECURSIVE {_M} SELECT 'r' || relation AS id FROM k UNION SELECT 'w' || way FROM m WHERE no % 2 = 1 AND way NOT IN (SELECT m.way FROM m WHERE outer_ AND relation IN (SELECT relation FROM k))",
)
def assembled_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings: relations that could be assembled, and marked ways that none of these replaces."""
    members = _outlines(spark, sf_dir)
    found = rings.assemble(members)
    ways = members.where("no % 2 = 1").select("way").join(rings.replaced(members, found), "way", "left_anti")
    return found.select(F.concat(F.lit("r"), "relation").alias("id")).union(ways.select(F.concat(F.lit("w"), "way"))).distinct()


_NATIONS = "n AS (SELECT c_nationkey AS k, CAST(sum(greatest(CAST(round(c_acctbal * 100) AS BIGINT), 0)) AS BIGINT) AS w FROM customer GROUP BY c_nationkey)"


@query(
    "largest_remainder",
    f"""WITH {_NATIONS}, t AS (SELECT CAST(sum(w) AS BIGINT) AS t FROM n), b AS (SELECT k, w, CAST(10007::HUGEINT * w // t AS BIGINT) AS base, 10007::HUGEINT * w % t AS rem FROM n, t)
    SELECT k, w, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, k) <= 10007 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS share FROM b""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10007 units over nations by balance, to the unit."""
    n = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum(F.greatest(cents(F.col("c_acctbal")), F.lit(0))).alias("w"))
    return alloc.largest_remainder(n, 10007, "w", "k")


@query(
    "capped_cascade",
    """WITH c AS (SELECT c_custkey, c_nationkey, n_regionkey, greatest(CAST(floor(c_acctbal) AS BIGINT), 0) AS cap FROM customer JOIN nation ON c_nationkey = n_nationkey),
    d AS (SELECT n_nationkey AS k, n_regionkey AS r, CAST(n_nationkey AS BIGINT) * 20011 AS amount FROM nation),
    s1 AS (SELECT c.*, sum(cap) OVER (PARTITION BY c_nationkey) AS total, amount FROM c JOIN d ON d.k = c_nationkey),
    g1 AS (SELECT *, CAST(CASE WHEN total > 0 THEN least(amount, total) * cap // total ELSE 0 END AS BIGINT) AS given FROM s1),
    left1 AS (SELECT d.r, CAST(sum(amount - coalesce(g, 0)) AS BIGINT) AS amount FROM d LEFT JOIN (SELECT c_nationkey, sum(given) AS g FROM g1 GROUP BY 1) ON c_nationkey = d.k GROUP BY d.r),
    s2 AS (SELECT g1.c_custkey, g1.given, g1.cap - g1.given AS room, sum(g1.cap - g1.given) OVER (PARTITION BY n_regionkey) AS total, l.amount FROM g1 JOIN left1 l ON l.r = n_regionkey)
    SELECT c_custkey, given AS stage1, CAST(CASE WHEN total > 0 THEN least(amount, total) * room // total ELSE 0 END AS BIGINT) AS stage2 FROM s2""",
)
def capped_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts go out inside nations up to capacity, what is left inside regions by remaining room."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", (F.col("n_nationkey").cast("long") * 20011).alias("amount"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("cap"))
    one = alloc.give(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), "amount", "cap", ["c_nationkey"])
    one = one.select("c_custkey", "c_nationkey", "n_regionkey", F.col("given").alias("stage1"), (F.col("cap") - F.col("given")).alias("room"))
    used = one.groupBy("c_nationkey").agg(F.sum("stage1").alias("g"))
    left = n.join(used, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.sum(F.col("amount") - F.coalesce("g", F.lit(0))).alias("amount"))
    two = alloc.give(one.join(left, "n_regionkey"), "amount", "room", ["n_regionkey"])
    return two.select("c_custkey", "stage1", F.col("given").alias("stage2"))


@query("method_argmax", "SELECT l_orderkey, CASE WHEN a >= n AND a >= r THEN 'A' WHEN n >= r THEN 'N' ELSE 'R' END AS method FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)")
def method_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that gave most; ties go to the earlier one."""
    n = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*(F.count_if(F.col("l_returnflag") == f).alias(f) for f in "ANR"))
    best = F.array_max(F.array(*(F.struct(F.col(f).alias("n"), F.lit(-i).alias("stage"), F.lit(f).alias("name")) for i, f in enumerate("ANR"))))
    return n.select("l_orderkey", best["name"].alias("method"))


@query("balanced_groups", "SELECT c_custkey, CAST(floor((rn * ceil(n / 12.0)) / n) AS BIGINT) AS grp FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS rn, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer)")
def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams of twelve at most, whose sizes differ by one at most."""
    w = W.Window.partitionBy("c_nationkey", "c_mktsegment")
    c = read(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w.orderBy("c_custkey")) - 1).withColumn("n", F.count("*").over(w))
    return c.select("c_custkey", alloc.balanced_group(F.col("rn"), F.col("n"), 12).alias("grp"))


@query(
    "topk_weighted",
    """SELECT o_custkey, CAST(r AS INTEGER) AS rank, l_partkey, w FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, l_partkey) AS r FROM
    (SELECT o_custkey, l_partkey, max(CAST(round(l_extendedprice * 100) AS BIGINT) // (1 + l_partkey % 7)) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)) WHERE r <= 8""",
)
def topk_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each home's eight heaviest candidates; the rank limit is applied before the shuffle, too."""
    w = cents(F.col("l_extendedprice"))
    d = 1 + F.col("l_partkey") % 7
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", ((w - w % d) / d).cast("long").alias("w"))
    each = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.max("w").alias("w"))
    order = W.Window.partitionBy("o_custkey").orderBy(F.col("w").desc(), "l_partkey")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 8").select("o_custkey", "rank", "l_partkey", "w")


@query(
    "cumulative_threshold",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) THEN 4294967295 ELSE CAST(floor(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) * 4294967296::BIGINT / sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey)) AS BIGINT) END AS upto FROM lineitem""",
)
def cumulative_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw thresholds of weighted choices; the last takes all that is left."""
    w = W.Window.partitionBy("l_orderkey")
    q = F.col("l_quantity").cast("long")
    upto = F.floor(F.sum(q).over(w.orderBy("l_linenumber")) * F.lit(1 << 32) / F.sum(q).over(w))
    last = F.col("l_linenumber") == F.max("l_linenumber").over(w)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(last, F.lit((1 << 32) - 1)).otherwise(upto).cast("long").alias("upto"))


@query("stratified_sample", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS r FROM orders) WHERE r <= 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty of each stratum, by a multiplicative hash of the key."""
    w = W.Window.partitionBy("o_orderstatus").orderBy((F.col("o_orderkey") * F.lit(2654435761)) % F.lit(1 << 32), "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 50").select("o_orderkey", "o_orderstatus")
