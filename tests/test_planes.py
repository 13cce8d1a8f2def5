"""Queries whose plane ends at a fixed side, with more suppliers than fill it."""

import duckdb
import pytest

from kvartal.plans import registry

_TABLES = {
    "supplier": "SELECT CAST(i AS BIGINT) AS s_suppkey FROM range(1, 2501) t(i)",
    "customer": "SELECT CAST(i AS BIGINT) AS c_custkey, 'x' AS c_mktsegment FROM range(1, 201) t(i)",
}
#: Pairs of the fixed plane.
_PAIRS = """p AS (SELECT c_custkey AS p_id, c_custkey * 7919 % 20011 AS x, c_custkey * 5003 % 19993 AS y FROM customer),
    s AS (SELECT s_suppkey AS s_id, s_suppkey * 6007 % 20011 AS cx, s_suppkey * 9973 % 19993 AS cy, 300 + s_suppkey % 7 * 200 AS a, 200 + s_suppkey % 5 * 300 AS b FROM supplier),
    n AS (SELECT p_id, s_id, a * b AS area FROM p, s WHERE abs(x - cx) * b + abs(y - cy) * a <= a * b)"""
_WANT = {
    "points_in_sites": "SELECT p_id, s_id FROM n",
    "smallest_site": "SELECT p_id, arg_min(s_id, (area, s_id)) AS s_id FROM n GROUP BY p_id",
    "facility_buildings": "SELECT s_id, count(*), string_agg(CAST(p_id AS VARCHAR), ',' ORDER BY p_id) FROM (SELECT s_id, p_id FROM n UNION SELECT s_suppkey, s_suppkey * 3 FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY s_id",
}


@pytest.mark.parametrize("name", [*_WANT])
def test_sites_around_a_point_grow_with_suppliers(spark, tmp_path, name):
    db = duckdb.connect()
    for table, sql in _TABLES.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = sorted(db.execute(f"WITH {_PAIRS} {_WANT[name]}").fetchall())
    got = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
    assert got == want and sorted(db.execute(registry.oracle_sql()[name]).fetchall()) == want
