"""Every rule holds for a sound package, and tells a fault planted in it."""

import duckdb
import pytest

from kvartal.operators.crossrules import SHARES, CrossRules, city_rules
from kvartal.plans import registry


def package():
    zones = [(z, z // 3, z % 3, 0) for z in range(9)]
    nodes = [(n, 100 + 7 * n, n % 5 * 60_000, n // 5 * 60_000) for n in range(20)]
    edges = sorted((a, b) for a in range(20) for b in (a + 1, a + 5) if b < 20 and (a % 5 < 4 or b == a + 5))
    arcs = []
    for k, (a, b) in enumerate(edges):
        for rev in (0, 1):
            arcs.append([*((b, a) if rev else (a, b)), 50 + k, k % 2, rev, 2 * k + rev, 60_000, k % 2, k % 7 == 0 and k % 2 == 0, k % 3, False, False, 0])
    arcs.sort(key=lambda x: (x[0], x[1], x[2], x[3], x[4]))
    arcs = [(i, *x) for i, x in enumerate(arcs)]
    buildings, residents = [], [0] * 9
    for b in range(40):
        x, y, f = b * 7_001 % 300_000, b * 31_007 % 300_000, b % 9
        zone = x // 100_000 * 3 + y // 100_000
        residents[zone] += b
        shares = [0] * 8 if f == 0 else [1000 if k != f - 1 else 3020 for k in range(8)]
        node = b % 20 if b % 3 else None
        buildings.append((b, zone, x, y, b, node, node, f, *shares))
    zones = [(*z[:3], n) for z, n in zip(zones, residents)]
    stops = [(s, 1000 + s, s, s // 3 * 100_000 + 5, s % 3 * 100_000 + 5) for s in range(9)]
    return {
        "zones": ("row long, ix long, iy long, residents long", zones),
        "road_nodes": ("row long, osm_id long, x_cm long, y_cm long", nodes),
        "road_arcs": ("row long, source long, to long, way_id long, way_part long, reverse long, by_edge long, length_cm long, car long, pedestrian boolean, road_class long, bridge boolean, tunnel boolean, layer long", arcs),
        "buildings": ("row long, zone long, x_cm long, y_cm long, residents long, road_node_depart long, road_node_arrive long, function long, " + ", ".join(f"share_{s} long" for s in SHARES), buildings),
        "stops": ("row long, osm_id long, zone long, x_cm long, y_cm long", stops),
        "facility_buildings": ("facility long, building long", [(f, b) for f in range(4) for b in range(f, 40, 7)]),
        "transit_periods": ("row long, start_s long, end_s long", [(0, 21_600, 36_000), (1, 36_000, 79_200), (2, 79_200, 21_600)]),
        "transit_headways": ("mode long, period long", [(m, p) for m in range(3) for p in range(3)]),
    }


def broken(spark, faults):
    """Rules that a package violates after ``faults``: (table, row, column, value), a row to be dropped if there is no column."""
    tables = {n: (s, [list(r) for r in rows]) for n, (s, rows) in package().items()}
    for table, row, column, value in faults:
        schema, rows = tables[table]
        names = [c.split()[0] for c in schema.split(", ")]
        if column is None:
            rows.append(list(value))
        else:
            rows[row][names.index(column)] = value
    frames = {n: spark.createDataFrame(rows, s) for n, (s, rows) in tables.items()}
    return {r.check_name: r.violations for r in city_rules(frames).report().collect()}


FAULTS = [
    ("buildings: point in its zone", ("buildings", 5, "x_cm", 299_999)),
    ("stops: point in its zone", ("stops", 4, "y_cm", 200_101)),
    ("buildings: nobody outside zones", ("buildings", 7, "zone", None)),
    ("buildings: road both ways or none", ("buildings", 1, "road_node_arrive", None)),
    ("buildings: unknown use without shares", ("buildings", 9, "share_retail", 5)),
    ("buildings: shares make one", ("buildings", 1, "share_other", 1041)),
    ("buildings: use of the greatest share", ("buildings", 2, "function", 1)),
    ("zones: residents of their buildings", ("buildings", 3, "residents", 4)),
    ("zones: in order of cells", ("zones", 4, "iy", 0)),
    ("stops: in order of ids", ("stops", 4, "osm_id", 1003)),
    ("road_nodes: in order of ids", ("road_nodes", 9, "osm_id", 5)),
    ("road_arcs: in order of ends and ways", ("road_arcs", 3, "source", 19)),
    ("road_arcs: two ways of each edge", ("road_arcs", 0, "reverse", 1)),
    ("road_arcs: both between the same ends", ("road_arcs", 0, "to", 13)),
    ("road_arcs: both alike", ("road_arcs", 6, "layer", 1)),
    ("road_arcs: by_edge names each once", ("road_arcs", 6, "by_edge", 1)),
    ("road_arcs: by_edge from 0 on", ("road_arcs", 6, "by_edge", 400)),
    ("road_arcs: no cars on footways", ("road_arcs", 1, "pedestrian", True)),
    ("road_arcs: no shorter than straight", ("road_arcs", 2, "length_cm", 59_979)),
    ("facilities: each building once", ("facility_buildings", 0, None, (0, 7))),
    ("periods: make a day", ("transit_periods", 1, "end_s", 79_201)),
    ("periods: begin where one ends", ("transit_periods", 1, "start_s", 36_001)),
    ("headways: each mode and period once", ("transit_headways", 0, "period", 1)),
    ("headways: of a period", ("transit_headways", 0, "period", 9)),
]


def test_a_sound_package_violates_nothing(spark):
    got = broken(spark, [])
    assert set(got.values()) == {0} and {n for n, _ in FAULTS} <= set(got) and len(got) == len(FAULTS) + 1


@pytest.mark.parametrize("some", [FAULTS[::3], FAULTS[1::3], FAULTS[2::3]], ids=["a", "b", "c"])
def test_planted_faults_are_told(spark, some):
    got = broken(spark, [f for _, f in some])
    assert [n for n, _ in some if not got[n]] == []


def test_rows_far_apart_are_neighbours(spark):
    nodes = spark.createDataFrame([(0, 50), (7, 60), (200_000, 40), (900_000, 45)], "row long, osm_id long")
    assert {r.check_name: r.violations for r in CrossRules({"n": nodes}).ascending("ordered", "n", "row", ["osm_id"]).report().collect()} == {"ordered": 1}


def test_prices_become_lengths_by_the_nearest_whole_number(spark, sf_dir, tmp_path):
    """Arcs just as long as they must be, if their price is rounded, and too short if it is cut off."""
    db = duckdb.connect()
    tables = {
        "customer": "SELECT CAST(i AS BIGINT) AS c_custkey, CAST(i % 25 AS INTEGER) AS c_nationkey FROM range(1000) t(i)",
        "nation": f"FROM '{sf_dir}/nation.parquet'",
        "orders": "SELECT i AS o_orderkey, (i * 7) % 1000 AS o_custkey, greatest(0, floor(sqrt(dx * dx + dy * dy) - 20)) + 0.75 AS o_totalprice FROM (SELECT i, (i * 7) % 1000 * 37 % 1009 - i % 1000 * 37 % 1009 AS dx, (i * 7) % 1000 * 41 % 2003 - i % 1000 * 41 % 2003 AS dy FROM range(1000) t(i))",
    }
    for table, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = dict(db.execute(registry.oracle_sql()["package_rules"]).fetchall())
    got = {r.check_name: r.violations for r in registry.queries()["package_rules"](spark, str(tmp_path)).collect()}
    assert got == want and want["road_arcs: no shorter than straight"] == 0
