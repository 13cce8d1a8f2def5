"""The rules between a package's tables, over tables that the driver's stand for, with faults among them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.operators.cascade import cascade
from kvartal.operators.crossrules import SHARES, city_rules
from kvartal.plans.registry import query
from kvartal.scratch import Scratch
from kvartal.sources.tables import read

_SHARE = {s: f"CASE WHEN c_custkey % 9 = 0 THEN CASE WHEN c_custkey % 45 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN c_custkey % 9 = {i + 1} THEN 1255 + c_custkey % 50 ELSE 1250 + {i} END END" for i, s in enumerate(SHARES)}
_BUILDINGS = [
    "c_custkey AS row", "CASE WHEN c_custkey % 211 <> 5 THEN c_nationkey END AS zone", "CAST(c_nationkey AS BIGINT) % 5 * 100000 + c_custkey * 7 % 100120 AS x_cm", "c_custkey * 11 % 100103 AS y_cm",
    "c_custkey % 4 AS residents", "CASE WHEN c_custkey % 10 > 0 THEN c_custkey END AS road_node_depart", "CASE WHEN c_custkey % 10 > 0 AND c_custkey % 97 > 0 THEN c_custkey END AS road_node_arrive", "c_custkey % 9 AS function",
    *(f"{e} AS share_{s}" for s, e in _SHARE.items()),
]
_ARC = "o_custkey AS tail, o_orderkey % 1000 AS head, o_orderkey AS way_id, 0 AS way_part, CAST(o_totalprice AS BIGINT) AS length_cm, o_orderkey % 3 AS car, o_orderkey % 30 = 7 AS pedestrian, o_orderkey % 5 AS layer"
_TABLES = f"""b AS (SELECT {", ".join(_BUILDINGS)} FROM customer),
    z AS (SELECT n_nationkey AS row, n_nationkey % 5 AS ix, 0 AS iy, coalesce(r, 0) + CASE WHEN n_nationkey = 7 THEN 1 ELSE 0 END AS residents FROM nation LEFT JOIN (SELECT zone, sum(residents) AS r FROM b GROUP BY zone) ON zone = n_nationkey),
    n AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 50 = 49 THEN 0 ELSE c_custkey * 3 END AS osm_id, c_custkey * 37 % 1009 AS x_cm, c_custkey * 41 % 2003 AS y_cm FROM customer),
    o AS (SELECT {_ARC} FROM orders),
    a AS (SELECT tail AS source, head AS to_, way_id, way_part, 0 AS reverse, 2 * way_id AS by_edge, length_cm, car, pedestrian, layer, 2 * way_id AS row FROM o
      UNION ALL SELECT CASE WHEN way_id % 400 = 3 THEN tail ELSE head END, tail, way_id, way_part, 1, 2 * way_id + CASE WHEN way_id % 500 = 9 THEN 0 ELSE 1 END, length_cm, car, pedestrian, layer + CASE WHEN way_id % 700 = 1 THEN 1 ELSE 0 END, 2 * way_id + 1 FROM o WHERE way_id % 300 <> 8)"""


def _count(name: str, from_: str, wrong: str) -> str:
    return f"SELECT '{name}' AS check_name, count(*) FILTER (NOT coalesce({wrong}, false)) AS violations FROM {from_}"


_TOTAL = " + ".join(f"share_{s}" for s in SHARES)
_EDGES = "(SELECT count(*) AS c, sum(reverse) AS r, count(DISTINCT least(source, to_)) AS l, count(DISTINCT greatest(source, to_)) AS g, count(*) FILTER (source = to_) AS loops, count(DISTINCT source) AS s, count(DISTINCT to_) AS t, count(DISTINCT length_cm) + count(DISTINCT layer) AS alike FROM a GROUP BY way_id, way_part)"
_OFF = "greatest(zone.{1} * 100000 - b.{0}, b.{0} - (zone.{1} + 1) * 100000, 0)"
_ORDERED = "(SELECT {0} AS k, lag({0}) OVER (ORDER BY row) AS p FROM {1})"
_CHECKS = [
    ("buildings: point in its zone", "b LEFT JOIN z zone ON b.zone = zone.row", f"b.zone IS NULL OR {_OFF.format('x_cm', 'ix')} ** 2 + {_OFF.format('y_cm', 'iy')} ** 2 <= 10000"),
    ("buildings: nobody outside zones", "b", "zone IS NOT NULL OR residents = 0"),
    ("buildings: road both ways or none", "b", "(road_node_depart IS NULL) = (road_node_arrive IS NULL)"),
    ("buildings: unknown use without shares", "b", f"function <> 0 OR {_TOTAL} = 0"),
    ("buildings: shares make one", "b", f"function = 0 OR abs({_TOTAL} - 10000) <= 40"),
    ("buildings: use of the greatest share", "b", f"function = 0 OR [{', '.join(f'share_{s}' for s in SHARES)}][function] = greatest({', '.join(f'share_{s}' for s in SHARES)})"),
    ("buildings: ids for all residents", "(SELECT sum(residents) AS s FROM b)", "s < 2147483648"),
    ("zones: residents of their buildings", "z FULL JOIN (SELECT zone, sum(residents) AS r FROM b WHERE zone IS NOT NULL GROUP BY zone) ON zone = row", "row IS NOT NULL AND residents = coalesce(r, 0)"),
    ("zones: in order of cells", _ORDERED.format("(ix, iy)", "z"), "p IS NULL OR k > p"),
    ("road_nodes: in order of ids", _ORDERED.format("osm_id", "n"), "p IS NULL OR k > p"),
    ("road_arcs: in order of ends and ways", _ORDERED.format("(source, to_, way_id, way_part, reverse)", "a"), "p IS NULL OR k > p"),
    ("road_arcs: two ways of each edge", _EDGES, "c = 2 AND r = 1"),
    ("road_arcs: both between the same ends", _EDGES, "l = 1 AND g = 1 AND loops IN (0, 2) AND (s = 2 OR t = 1)"),
    ("road_arcs: both alike", _EDGES, "alike = 2"),
    ("road_arcs: by_edge names each once", "(SELECT count(*) AS c FROM a GROUP BY by_edge)", "c = 1"),
    ("road_arcs: by_edge from 0 on", "(SELECT count(*) AS c, min(by_edge) AS l, max(by_edge) AS m FROM a)", "c = 0 OR l = 0 AND m = c - 1"),
    ("road_arcs: no cars on footways", "a", "NOT pedestrian OR car = 0"),
    ("road_arcs: no shorter than straight", "a LEFT JOIN n tail ON tail.row = source LEFT JOIN n head ON head.row = to_", "length_cm >= sqrt(CAST((head.x_cm - tail.x_cm) ** 2 + (head.y_cm - tail.y_cm) ** 2 AS DOUBLE)) - 20"),
]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Buildings and nodes are customers, zones nations, edges orders."""
    c = read(spark, sf_dir, "customer")
    b = c.selectExpr(*_BUILDINGS)
    r = b.groupBy("zone").agg(F.sum("residents").alias("r"))
    z = read(spark, sf_dir, "nation").join(r, F.col("zone") == F.col("n_nationkey"), "left")
    z = z.selectExpr("n_nationkey AS row", "n_nationkey % 5 AS ix", "0 AS iy", "coalesce(r, 0) + CASE WHEN n_nationkey = 7 THEN 1 ELSE 0 END AS residents")
    n = c.selectExpr("c_custkey AS row", "CASE WHEN c_custkey % 50 = 49 THEN 0 ELSE c_custkey * 3 END AS osm_id", "c_custkey * 37 % 1009 AS x_cm", "c_custkey * 41 % 2003 AS y_cm")
    # the SQL's cast takes a price to the nearest whole number, Spark's cuts it off
    arc = _ARC.replace("CAST(o_totalprice AS BIGINT)", "CAST(rint(o_totalprice) AS BIGINT)")
    o = read(spark, sf_dir, "orders").selectExpr(*arc.split(", "), "false AS bridge", "false AS tunnel")
    one = o.selectExpr("tail AS source", "head AS to", "way_id", "way_part", "0 AS reverse", "2 * way_id AS by_edge", "length_cm", "car", "pedestrian", "layer", "bridge", "tunnel", "2 * way_id AS row")
    two = o.where("way_id % 300 <> 8").selectExpr(
        "CASE WHEN way_id % 400 = 3 THEN tail ELSE head END AS source", "tail AS to", "way_id", "way_part", "1 AS reverse", "2 * way_id + CASE WHEN way_id % 500 = 9 THEN 0 ELSE 1 END AS by_edge", "length_cm", "car", "pedestrian",
        "layer + CASE WHEN way_id % 700 = 1 THEN 1 ELSE 0 END AS layer", "bridge", "tunnel", "2 * way_id + 1 AS row",
    )
    return {"buildings": b, "zones": z, "road_nodes": n, "road_arcs": one.unionByName(two)}


@query("package_rules", f"WITH {_TABLES} " + " UNION ALL ".join(_count(*x) for x in _CHECKS))
def package_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of a package is violated."""
    return city_rules(tables(spark, sf_dir)).report()


_SIDE = "(SELECT 640 * CAST(floor(sqrt(count(*))) AS BIGINT) + 211 AS side FROM supplier)"
_CELL, _ZONE = "x // 400 * 100000 + y // 400", "x // 1000 * 100000 + y // 1000"
_HOMES = f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 31 > 0 THEN {_CELL} END AS cell, CASE WHEN c_custkey % 37 > 0 THEN {_ZONE} END AS zone,
    CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 * 10 ELSE 0 END AS known, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 3 * 15 ELSE 0 END AS unknown
    FROM (SELECT c_custkey, c_custkey * 7919 % side AS x, c_custkey * 5003 % (side - 18) AS y FROM customer, {_SIDE})"""
_CELLS = f"""SELECT {_CELL} AS cell, CASE WHEN min(k) % 17 > 0 THEN min({_ZONE}) END AS zone, CAST(sum(k % 13 * 11) AS BIGINT) AS amount
    FROM (SELECT p_partkey AS k, p_partkey * 6007 % side AS x, p_partkey * 9973 % (side + 4000) AS y FROM part, {_SIDE}) GROUP BY 1"""
_ZONES = """SELECT zone, zone // 100000 // 3 * 1000 + zone % 100000 // 3 AS block, zone // 100000 * 1000 + 500 AS x, zone % 100000 * 1000 + 500 AS y, 1 + zone % 7 AS area
    FROM (SELECT zone FROM b0 UNION SELECT zone FROM c0) WHERE zone IS NOT NULL"""
_STAGED = (("cell", "known"), ("cell", "unknown"), ("zone", "known"), ("zone", "unknown"), ("block", "known"), ("block", "unknown"))


def _cascade_sql() -> str:
    parts = [f"b0 AS ({_HOMES}), c0 AS ({_CELLS}), z0 AS ({_ZONES})", "g0 AS (SELECT b0.*, block, 0::BIGINT AS got FROM b0 LEFT JOIN z0 USING (zone))", "p1 AS (SELECT cell, amount FROM c0)"]
    for k, (key, area) in enumerate(_STAGED, 1):
        parts.append(f"r{k} AS (SELECT *, CASE WHEN {area} > 0 THEN greatest(2 * {area} - got, 0) ELSE 0 END AS room FROM g{k - 1})")
        parts.append(f"t{k} AS (SELECT {key}, sum(room) AS total FROM r{k} WHERE room > 0 GROUP BY {key})")
        parts.append(f"s{k} AS (SELECT r.*, CAST(CASE WHEN amount > 0 AND total > 0 THEN least(amount, total) * room // total ELSE 0 END AS BIGINT) AS stage{k} FROM r{k} r LEFT JOIN p{k} USING ({key}) LEFT JOIN t{k} USING ({key}))")
        parts.append(f"g{k} AS (SELECT * EXCLUDE (room, got), got + stage{k} AS got FROM s{k})")
        parts.append(f"q{k} AS (SELECT p.{key}, amount - coalesce(gone, 0) AS amount FROM p{k} p LEFT JOIN (SELECT {key}, sum(stage{k}) AS gone FROM g{k} GROUP BY {key}) USING ({key}))")
        wider = {2: "SELECT zone, sum(q2.amount) AS amount FROM q2 JOIN c0 USING (cell) WHERE zone IS NOT NULL GROUP BY zone", 4: "SELECT block, sum(amount) AS amount FROM q4 JOIN z0 USING (zone) GROUP BY block"}
        parts.append(f"p{k + 1} AS ({wider.get(k, f'FROM q{k}')})")
    for k in (7, 8):
        w = "CASE WHEN block IS NULL THEN 0 ELSE known + unknown END"
        parts.append(f"r{k} AS (SELECT *, {w} AS w, sum({w}) OVER (PARTITION BY block ORDER BY id) AS upto, sum({w}) OVER (PARTITION BY block) AS total FROM g{k - 1})")
        parts.append(f"s{k} AS (SELECT r.*, CAST(CASE WHEN total > 0 AND amount IS NOT NULL THEN amount * upto // total - amount * (upto - w) // total ELSE 0 END AS BIGINT) AS stage{k} FROM r{k} r LEFT JOIN p{k} USING (block))")
        parts.append(f"g{k} AS (SELECT * EXCLUDE (w, upto, total, got), got + stage{k} AS got FROM s{k})")
        if k == 7:
            parts.append("q7 AS (SELECT p.block, amount - coalesce(gone, 0) AS amount FROM p7 p LEFT JOIN (SELECT block, sum(stage7) AS gone FROM g7 GROUP BY block) USING (block) WHERE amount > coalesce(gone, 0))")
            parts.append("m AS (SELECT block, sum(area * x) // sum(area) AS x, sum(area * y) // sum(area) AS y FROM z0 GROUP BY block), e AS (SELECT block FROM g7 WHERE block IS NOT NULL GROUP BY block HAVING sum(known + unknown) > 0)")
            parts.append("p8 AS (SELECT block, sum(amount) AS amount FROM (SELECT (SELECT arg_min(e.block, ((h.x - m.x) * (h.x - m.x) + (h.y - m.y) * (h.y - m.y), e.block)) FROM e JOIN m h USING (block)) AS block, amount FROM q7 JOIN m USING (block)) GROUP BY block)")
    return f"WITH {', '.join(parts)} SELECT id, {', '.join(f'stage{k}' for k in range(1, 9))}, got FROM g8"


@query("population_cascade", _cascade_sql())
def population_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residents of cells in buildings, by the stage that placed them."""
    n = 640 * math.isqrt(read(spark, sf_dir, "supplier").count()) + 211
    for name in ("customer", "part"):
        read(spark, sf_dir, name).createOrReplaceTempView(f"_cascade_{name}")
    plain = lambda sql: sql.replace("//", "div").replace(f", {_SIDE.replace('//', 'div')}", "").replace("side", str(n)).replace("FROM customer", "FROM _cascade_customer").replace("FROM part", "FROM _cascade_part")
    scratch = Scratch(spark, "homes")
    homes, cells = scratch.save(spark.sql(plain(_HOMES)), "homes"), scratch.save(spark.sql(plain(_CELLS)), "cells")
    zone = F.col("zone")
    ix, iy = F.expr("zone div 100000"), zone % 100000
    zones = homes.select("zone").union(cells.select("zone")).where("zone IS NOT NULL").distinct()
    zones = zones.select("zone", (F.floor(ix / 3) * 1000 + F.floor(iy / 3)).cast("long").alias("block"), (ix * 1000 + 500).alias("x"), (iy * 1000 + 500).alias("y"), (1 + zone % 7).alias("area"))
    return cascade(homes, cells, zones, 2)[0]
