"""Points, polygons and segments: zones, sites, edges, borders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.functions import walking
from kvartal.operators import shapes
from kvartal.operators.grid import cell
from kvartal.plans.registry import query
from kvartal.sources.tables import read

SIZE, TOLERANCE = 1000, 50

#: The plane grows with the suppliers, so that each has as many neighbours at any scale.
_SIDE = "(SELECT 640 * CAST(floor(sqrt(count(*))) AS BIGINT) + 211 AS side FROM supplier)"
#: Side that the plane of ``_DENSE`` queries does not pass: beyond it the sites around a point grow with the suppliers.
MOST_SIDE = 20011


def _plane(side: str) -> tuple[str, str]:
    p = f"p AS (SELECT c_custkey AS p_id, c_custkey * 7919 % side AS x, c_custkey * 5003 % (side - 18) AS y FROM customer, {side})"
    return p, f"s AS (SELECT s_suppkey AS s_id, s_suppkey * 6007 % side AS cx, s_suppkey * 9973 % (side - 18) AS cy, 300 + s_suppkey % 7 * 200 AS a, 200 + s_suppkey % 5 * 300 AS b FROM supplier, {side})"


_P, _S = _plane(_SIDE)
_DENSE = ", ".join(_plane(f"(SELECT least({MOST_SIDE}, side) AS side FROM {_SIDE})"))
_IN = "abs(x - cx) * b + abs(y - cy) * a <= a * b"
_E = "e AS (SELECT s_id AS e_id, cx AS ax, cy AS ay, cx + s_id % 11 * 150 - 750 AS bx, cy + s_id % 13 * 120 - 720 AS yb FROM s)"


def _seg(ax: str, ay: str, bx: str, by: str) -> str:
    along = f"((x - {ax}) * ({bx} - {ax}) + (y - {ay}) * ({by} - {ay}))"
    whole = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    side = f"CAST(({bx} - {ax}) * (y - {ay}) - (x - {ax}) * ({by} - {ay}) AS DOUBLE)"
    d2 = lambda px, py: f"CAST((x - {px}) * (x - {px}) + (y - {py}) * (y - {py}) AS DOUBLE)"
    return f"CASE WHEN {along} <= 0 THEN {d2(ax, ay)} WHEN {along} >= {whole} THEN {d2(bx, by)} ELSE {side} * {side} / {whole} END"


_CORNERS = [("(cx - a)", "cy"), ("cx", "(cy - b)"), ("(cx + a)", "cy"), ("cx", "(cy + b)")]
_DIST = f"CASE WHEN {_IN} THEN 0.0::DOUBLE ELSE least({', '.join(_seg(*p, *q) for p, q in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1]))}) END"


def side(spark: SparkSession, sf_dir: str, most: int | None = None) -> int:
    """Side of the plane, ``most`` at most."""
    n = 640 * math.isqrt(read(spark, sf_dir, "supplier").count()) + 211
    return n if most is None else min(n, most)


def points(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    k, n = F.col("c_custkey"), side(spark, sf_dir, most)
    return read(spark, sf_dir, "customer").select(k.alias("p_id"), (k * 7919 % n).alias("x"), (k * 5003 % (n - 18)).alias("y"), F.col("c_mktsegment").alias("kind"))


def sites(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Rhombic sites of all suppliers."""
    k, n = F.col("s_suppkey"), side(spark, sf_dir, most)
    at = read(spark, sf_dir, "supplier").select(k.alias("s_id"), (k * 6007 % n).alias("cx"), (k * 9973 % (n - 18)).alias("cy"), (300 + k % 7 * 200).alias("a"), (200 + k % 5 * 300).alias("b"))
    cx, cy, a, b = (F.col(c) for c in ("cx", "cy", "a", "b"))
    return at.select("s_id", shapes.ring_of((cx - a, cy), (cx, cy - b), (cx + a, cy), (cx, cy + b)).alias("ring"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), side(spark, sf_dir)
    at = read(spark, sf_dir, "supplier").select(k.alias("e_id"), (k * 6007 % n).alias("ax"), (k * 9973 % (n - 18)).alias("ay"))
    return at.select("e_id", "ax", "ay", (F.col("ax") + F.col("e_id") % 11 * 150 - 750).alias("bx"), (F.col("ay") + F.col("e_id") % 13 * 120 - 720).alias("by"))


@query("points_in_sites", f"WITH {_DENSE} SELECT p_id, s_id FROM p, s WHERE {_IN}")
def points_in_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site around every point."""
    return shapes.near_shapes(points(spark, sf_dir, MOST_SIDE), sites(spark, sf_dir, MOST_SIDE), SIZE).select("p_id", "s_id")


@query("site_uses", f"WITH {_P}, {_S} SELECT s_id, count(DISTINCT c_mktsegment) AS uses, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS which FROM p JOIN customer ON c_custkey = p_id, s WHERE {_IN} GROUP BY s_id")
def site_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct uses of the points in each site."""
    kinds = shapes.near_shapes(points(spark, sf_dir), sites(spark, sf_dir), SIZE).groupBy("s_id").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    return kinds.select("s_id", F.size("k").cast("long").alias("uses"), F.array_join("k", ";").alias("which"))


@query("smallest_site", f"WITH {_DENSE} SELECT p_id, arg_min(s_id, (a * b, s_id)) AS s_id FROM p, s WHERE {_IN} GROUP BY p_id")
def smallest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest site around each point."""
    return shapes.smallest_around(points(spark, sf_dir, MOST_SIDE), sites(spark, sf_dir, MOST_SIDE), SIZE)


@query("zone_with_tolerance", f"WITH {_P}, {_S} SELECT p_id, min(s_id) AS s_id FROM p, s WHERE {_DIST} <= {float(TOLERANCE * TOLERANCE)} GROUP BY p_id")
def zone_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first zone around a point or hardly off it."""
    return shapes.near_shapes(points(spark, sf_dir), sites(spark, sf_dir), SIZE, TOLERANCE).groupBy("p_id").agg(F.min("s_id").alias("s_id"))


@query("nearest_zone", f"WITH {_P}, {_S} SELECT p_id, arg_min(s_id, (d2, s_id)) AS s_id FROM (SELECT p_id, s_id, {_DIST} AS d2 FROM p, s) GROUP BY p_id")
def nearest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest zone of each point, however far."""
    return shapes.nearest_shape(points(spark, sf_dir), sites(spark, sf_dir)).select("p_id", "s_id")


@query("nearest_edge", f"WITH {_P}, {_S}, {_E} SELECT p_id, arg_min(e_id, (d2, e_id)) AS e_id, min(d2) AS d2 FROM (SELECT p_id, e_id, {_seg('ax', 'ay', 'bx', 'yb')} AS d2 FROM p, e) GROUP BY p_id")
def nearest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest road edge of each point, however far."""
    return shapes.nearest_edge(points(spark, sf_dir), segments(spark, sf_dir))


@query(
    "grid_zone",
    f"WITH {_P}, {_S} SELECT p_id, x // 1000 AS ix, y // 1000 AS iy FROM p WHERE (x // 1000 + y // 1000) % 3 <> 0 OR EXISTS (SELECT 1 FROM s WHERE s_id = 1 + (x // 1000 * 31 + y // 1000) % (SELECT count(*) FROM supplier) AND {_IN})",
)
def grid_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid zone of each point; every third zone is clipped by a polygon, which its points must lie in."""
    s, p = sites(spark, sf_dir), points(spark, sf_dir)
    n = s.count()
    at = p.select("p_id", "x", "y", cell(F.col("x"), 1000).alias("ix"), cell(F.col("y"), 1000).alias("iy"))
    zone = at.withColumn("clip", F.when((F.col("ix") + F.col("iy")) % 3 == 0, 1 + (F.col("ix") * 31 + F.col("iy")) % n))
    both = zone.join(s, F.col("clip") == F.col("s_id"), "left")
    ok = F.col("clip").isNull() | F.coalesce(shapes.inside(F.col("x"), F.col("y"), F.col("ring")), F.lit(False))
    return both.where(ok).select("p_id", "ix", "iy")


@query(
    "facility_buildings",
    f"WITH {_DENSE}, m AS (SELECT s_id, p_id FROM p, s WHERE {_IN} UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier WHERE s_suppkey % 2 = 0) SELECT s_id, count(*) AS n, string_agg(CAST(p_id AS VARCHAR), ',' ORDER BY p_id) AS buildings FROM m GROUP BY s_id",
)
def facility_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings of a facility: those in its site and those merged with it by id."""
    s = sites(spark, sf_dir, MOST_SIDE)
    own = shapes.ids_inside(points(spark, sf_dir, MOST_SIDE), s, SIZE)
    merged = s.where("s_id % 2 = 0").select("s_id", F.array(F.col("s_id") * 3).alias("ids"))
    lists = own.union(merged).groupBy("s_id").agg(F.flatten(F.collect_list("ids")).alias("b")).select("s_id", F.sort_array(F.array_distinct("b")).alias("b"))
    return lists.select("s_id", F.size("b").cast("long").alias("n"), F.array_join(F.col("b").cast("array<string>"), ",").alias("buildings"))


_W = "w AS (SELECT o_orderkey AS w_id, o_orderkey * 37 % 20011 AS ax, o_orderkey * 41 % 19993 AS ay, o_orderkey * 37 % 20011 + o_orderkey % 9 * 400 - 1601 AS bx, o_orderkey * 41 % 19993 + o_orderkey % 7 * 500 - 1499 AS yb FROM orders)"
#: The region that borders are tested with: a rhombus as a list of corners.
REGION = [(1000, 10000), (10000, 2000), (19000, 10000), (10000, 18000)]
_RIN = lambda x, y: f"(abs({x} - 10000) * 8000 + abs({y} - 10000) * 9000 <= 72000000)"


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = read(spark, sf_dir, "orders").select(k.alias("w_id"), (k * 37 % 20011).alias("ax"), (k * 41 % 19993).alias("ay"))
    k = F.col("w_id")
    return w.select("w_id", "ax", "ay", (F.col("ax") + k % 9 * 400 - 1601).alias("bx"), (F.col("ay") + k % 7 * 500 - 1499).alias("by"))


@query("road_ends", f"WITH {_W} SELECT w_id, CASE WHEN {_RIN('ax', 'ay')} AND {_RIN('bx', 'yb')} THEN 'inside' WHEN {_RIN('ax', 'ay')} OR {_RIN('bx', 'yb')} THEN 'border' ELSE 'outside' END AS ends FROM w")
def road_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ends of a road lie: both in the region, one, none."""
    ring = shapes.ring_of(*((F.lit(x), F.lit(y)) for x, y in REGION))
    a, b = (shapes.inside(F.col(f"{e}x"), F.col(f"{e}y"), ring) for e in "ab")
    return _ways(spark, sf_dir).select("w_id", F.when(a & b, "inside").when(a | b, "border").otherwise("outside").alias("ends"))


def _cross_sql() -> str:
    turn = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    a, b, out = ("ax", "ay"), ("bx", "yb"), []
    for e, f in zip(REGION, REGION[1:] + REGION[:1]):
        out.append(f"CASE WHEN {turn(a, b, e)} * {turn(a, b, f)} < 0 AND {turn(e, f, a)} * {turn(e, f, b)} < 0 THEN 1 ELSE 0 END")
    return " + ".join(out)


@query("boundary_crossings", f"WITH {_W} SELECT w_id, n AS crossings FROM (SELECT w_id, CAST({_cross_sql()} AS INTEGER) AS n FROM w) WHERE n > 0")
def boundary_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads that cross the region's border, and how often."""
    ring = shapes.ring_of(*((F.lit(x), F.lit(y)) for x, y in REGION))
    n = shapes.crossings(*(F.col(c) for c in ("ax", "ay", "bx", "by")), ring)
    return _ways(spark, sf_dir).select("w_id", n.alias("crossings")).where("crossings > 0")


_B = "b AS (SELECT p_partkey AS id, p_brand AS name, p_partkey * 53 % 20011 AS x1, p_partkey * 59 % 19993 AS y1, p_partkey * 53 % 20011 + 200 + p_size * 40 AS x2, p_partkey * 59 % 19993 + 300 + p_size * 30 AS y2 FROM part)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size").cast("long")
    p = read(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("name"), (k * 53 % 20011).alias("x1"), (k * 59 % 19993).alias("y1"), n.alias("n"))
    return p.select("id", "name", "x1", "y1", (F.col("x1") + 200 + F.col("n") * 40).alias("x2"), (F.col("y1") + 300 + F.col("n") * 30).alias("y2"))


_CLIPPED = "greatest(0, least(x2, 15000) - greatest(x1, 5000)) * greatest(0, least(y2, 16000) - greatest(y1, 4000))"


@query("clip_shares", f"WITH {_B} SELECT id, CAST({_CLIPPED} AS BIGINT) AS area, {_CLIPPED} * 10000 // ((x2 - x1) * (y2 - y1)) AS share_bp FROM b WHERE {_CLIPPED} > 0")
def clip_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes clipped to the region's rectangle: what is left, and its share."""
    b = _boxes(spark, sf_dir)
    area = (shapes.clip(F.col("x1"), F.col("x2"), F.lit(5000), F.lit(15000)) * shapes.clip(F.col("y1"), F.col("y2"), F.lit(4000), F.lit(16000))).cast("long")
    whole = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return b.select("id", area.alias("area"), F.floor(area * 10000 / whole).cast("long").alias("share_bp")).where("area > 0")


_OVER = "greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))"
_AREA = lambda t: f"(({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1))"


@query("area_dedup", f"WITH {_B} SELECT id FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.name = a.name AND c.id < a.id AND 2 * {_OVER} > least({_AREA('a')}, {_AREA('c')}))")
def area_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas without an earlier one of their name that overlaps the lesser of both by more than half."""
    b = _boxes(spark, sf_dir)
    spread = shapes._spread(b, (F.col("x1"), F.col("x2")), (F.col("y1"), F.col("y2")), 2000)
    a, c = spread.alias("a"), spread.alias("c")
    over = shapes.clip(F.col("a.x1"), F.col("a.x2"), F.col("c.x1"), F.col("c.x2")) * shapes.clip(F.col("a.y1"), F.col("a.y2"), F.col("c.y1"), F.col("c.y2"))
    area = lambda t: (F.col(f"{t}.x2") - F.col(f"{t}.x1")) * (F.col(f"{t}.y2") - F.col(f"{t}.y1"))
    same = (F.col("a.name") == F.col("c.name")) & (F.col("a._ix") == F.col("c._ix")) & (F.col("a._iy") == F.col("c._iy")) & (F.col("c.id") < F.col("a.id"))
    twice = a.join(c, same).where(2 * over > F.least(area("a"), area("c"))).select(F.col("a.id").alias("id")).distinct()
    return b.select("id").join(twice, "id", "left_anti")


@query("tile_members", f"WITH {_B} SELECT tx, ty, count(*) AS n FROM (SELECT id, unnest(range(x1 // 4096, x2 // 4096 + 1)) AS tx, y1, y2 FROM b) t, LATERAL (SELECT unnest(range(y1 // 4096, y2 // 4096 + 1)) AS ty) GROUP BY tx, ty")
def tile_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes each tile shows."""
    spread = shapes._spread(_boxes(spark, sf_dir), (F.col("x1"), F.col("x2")), (F.col("y1"), F.col("y2")), 4096)
    return spread.groupBy(F.col("_ix").alias("tx"), F.col("_iy").alias("ty")).agg(F.count("*").alias("n"))


@query("viewport_tiles", f"WITH {_B} SELECT DISTINCT tx, ty FROM (SELECT id, unnest(range(x1 // 4096, x2 // 4096 + 1)) AS tx, y1, y2 FROM b) t, LATERAL (SELECT unnest(range(y1 // 4096, y2 // 4096 + 1)) AS ty) WHERE tx BETWEEN 1 AND 3 AND ty BETWEEN 2 AND 4")
def viewport_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles with something to show inside a viewport."""
    return tile_members(spark, sf_dir).where("tx BETWEEN 1 AND 3 AND ty BETWEEN 2 AND 4").select("tx", "ty")


@query("pick_under", f"WITH {_P} SELECT p_id, (x - 10000) * (x - 10000) + (y - 9000) * (y - 9000) AS d2 FROM p WHERE (x - 10000) * (x - 10000) + (y - 9000) * (y - 9000) <= 2250000 ORDER BY d2, p_id LIMIT 8")
def pick_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest points around a place that was pointed at: a report of the first few."""
    d2 = (F.col("x") - 10000) * (F.col("x") - 10000) + (F.col("y") - 9000) * (F.col("y") - 9000)
    near = points(spark, sf_dir).where(F.col("x").between(8500, 11500) & F.col("y").between(7500, 10500))
    return near.select("p_id", d2.alias("d2")).where("d2 <= 2250000").orderBy("d2", "p_id").limit(8)


@query("raster_join", "SELECT c_custkey AS p_id, v FROM (SELECT c_custkey, c_custkey * 7919 % side // 500 AS col, c_custkey * 5003 % (side - 18) // 500 AS row FROM customer, (SELECT 640 * CAST(floor(sqrt(count(*))) AS BIGINT) + 211 AS side FROM supplier)) LEFT JOIN (SELECT p_partkey % 41 AS col, p_partkey // 41 % 40 AS row, CAST(sum(p_size) AS BIGINT) AS v FROM part GROUP BY ALL) USING (col, row)")
def raster_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster value of each point's cell; null where the raster has none."""
    k = F.col("p_partkey")
    raster = read(spark, sf_dir, "part").groupBy((k % 41).alias("col"), (F.floor(k / 41) % 40).alias("row")).agg(F.sum("p_size").cast("long").alias("v"))
    return points(spark, sf_dir).select("p_id", cell(F.col("x"), 500).alias("col"), cell(F.col("y"), 500).alias("row")).join(raster, ["col", "row"], "left").select("p_id", "v")


_T = f"t AS (SELECT s_suppkey AS id, s_suppkey * 6007 % side AS x, s_suppkey * 9973 % (side - 18) AS y, s_suppkey // 25 AS area FROM supplier, {_SIDE})"


@query(
    "transfer_pairs",
    f"""WITH {_T}, c AS (SELECT a.id AS a, b.id AS b, greatest(1, CAST(floor(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) / 10 * 1.3::DOUBLE / 1.2::DOUBLE + 30::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS w FROM t a JOIN t b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1000000
    UNION ALL SELECT a.id, b.id, 240 FROM t a JOIN t b ON a.area = b.area AND a.id <> b.id) SELECT a, b, min(w) AS walk FROM c GROUP BY a, b""",
)
def transfer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops between which one can change: near ones by distance, members of one area by its time, the lesser of both."""
    k = F.col("s_suppkey")
    n = side(spark, sf_dir)
    t = read(spark, sf_dir, "supplier").select(k.alias("id"), (k * 6007 % n).alias("x"), (k * 9973 % (n - 18)).alias("y"), F.expr("s_suppkey div 25").alias("area"))
    spread = shapes._spread(t, (F.col("x") - 1000, F.col("x") + 1000), (F.col("y") - 1000, F.col("y") + 1000), 1000).alias("b")
    own = t.withColumns({"_ix": cell(F.col("x"), 1000), "_iy": cell(F.col("y"), 1000)}).alias("a")
    d2 = (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")) + (F.col("a.y") - F.col("b.y")) * (F.col("a.y") - F.col("b.y"))
    near = own.join(spread, (F.col("a._ix") == F.col("b._ix")) & (F.col("a._iy") == F.col("b._iy")) & (F.col("a.id") != F.col("b.id"))).where(d2 <= 1_000_000)
    near = near.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), walking.transfer(F.sqrt(d2.cast("double")) / 10, 1.3, 1.2, 30).alias("walk"))
    one, two = t.alias("a"), t.alias("b")
    areas = one.join(two, (F.col("a.area") == F.col("b.area")) & (F.col("a.id") != F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.lit(240).cast("long").alias("walk"))
    return near.unionByName(areas).groupBy("a", "b").agg(F.min("walk").alias("walk"))
