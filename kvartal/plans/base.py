"""Typed scans, codes, masks, offsets, validation and grid rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions.rounding import cents
from kvartal.operators.grid import cell
from kvartal.operators.quantiles import quantiles
from kvartal.operators.rules import Rules
from kvartal.operators.seq import prefix_sum
from kvartal.plans.registry import query
from kvartal.sources.tables import read

ZONE_CENTS, ZONE_DAYS = 5_000_000, 90
#: Codes are positions in a fixed tuple.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id"}

_O = """o AS (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) // 5000000 AS ix,
         CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 90.0) AS BIGINT) AS iy,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)"""


def zoned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cents(F.col("o_totalprice"))
    return read(spark, sf_dir, "orders").select("o_orderkey", cell(c, ZONE_CENTS).alias("ix"), cell(F.unix_date(F.to_date("o_orderdate")), ZONE_DAYS).alias("iy"), c.alias("cents"))


@query(
    "zone_rollup",
    f"""WITH {_O}, xs AS (SELECT DISTINCT ix FROM o), ys AS (SELECT DISTINCT iy FROM o),
    z AS (SELECT ix, iy, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM o GROUP BY ix, iy)
    SELECT xs.ix, ys.iy, coalesce(n, 0) AS n_orders, coalesce(cents, 0) AS cents
    FROM xs CROSS JOIN ys LEFT JOIN z ON z.ix = xs.ix AND z.iy = ys.iy""",
)
def zone_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of every grid zone, empty zones included."""
    z = zoned_orders(spark, sf_dir).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    # the grid is made from the rolled-up cells, not from the rows
    axes = z.agg(F.collect_set("ix").alias("xs"), F.collect_set("iy").alias("ys"))
    grid = axes.select(F.explode("xs").alias("ix"), "ys").select("ix", F.explode("ys").alias("iy"))
    return grid.join(z, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("cents", F.lit(0)).alias("cents"))


@query("catalog_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST(min({k}) AS BIGINT) AS min_key, CAST(max({k}) AS BIGINT) AS max_key FROM {t}" for t, k in KEYS.items()))
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue row a table; counts and bounds come from Parquet statistics where they can."""
    one = lambda t, k: read(spark, sf_dir, t).agg(F.count("*").alias("n_rows"), F.min(k).cast("long").alias("min_key"), F.max(k).cast("long").alias("max_key")).withColumn("table_name", F.lit(t))
    return reduce(DataFrame.unionByName, (one(t, k) for t, k in KEYS.items()))


@query("code_dictionary", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def code_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a name column: its place among the sorted distinct names, which are few and joined by map."""
    o = read(spark, sf_dir, "orders")
    names = o.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("names"))
    return o.join(F.broadcast(names)).select("o_orderkey", (F.array_position("names", F.col("o_orderpriority")) - 1).alias("code"))


@query("mode_mask", "SELECT user_id, CAST(bit_or(1 << (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)) AS BIGINT) AS mask FROM events GROUP BY user_id")
def mode_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of codes as bit masks."""
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), code.cast("int"))).alias("mask"))


@query("csr_offsets", "SELECT l_orderkey, n, CAST(sum(n) OVER (ORDER BY l_orderkey) - n AS BIGINT) AS first FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First position of each order's lines in one pool."""
    sizes = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return prefix_sum(sizes, "n", "l_orderkey", "first")


@query("edge_permutation", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS by_edge FROM lineitem")
def edge_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines in another stable order."""
    w = W.Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).cast("long").alias("by_edge"))


@query(
    "rule_report",
    """WITH l AS (SELECT * FROM lineitem), sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT 'line_order_exists' AS check_name, CAST((SELECT count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS BIGINT) AS violations
    UNION ALL SELECT 'line_supplier_exists', (SELECT count(*) FROM l WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
    UNION ALL SELECT 'line_unique', (SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM l GROUP BY l_orderkey, l_suppkey))
    UNION ALL SELECT 'quantity_range', (SELECT count(*) FROM l WHERE NOT (l_quantity BETWEEN 1 AND 49))
    UNION ALL SELECT 'discount_range', (SELECT count(*) FROM l WHERE NOT (l_discount >= 0 AND l_discount < 0.1))
    UNION ALL SELECT 'flag_code', (SELECT count(*) FROM l WHERE l_returnflag NOT IN ('A', 'N'))
    UNION ALL SELECT 'nation_region_exists', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
    UNION ALL SELECT 'totals_equal', (SELECT count(*) FROM ((SELECT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation) UNION ALL (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM customer)))
    UNION ALL SELECT 'offsets', 0
    UNION ALL SELECT 'offsets_moved', (SELECT count(*) FILTER (o % 100 = 50) + count(*) FILTER (o % 100 = 50 AND o < m) FROM (SELECT dense_rank() OVER (ORDER BY l_orderkey) - 1 AS o, (SELECT count(DISTINCT l_orderkey) - 1 FROM l) AS m FROM (SELECT DISTINCT l_orderkey FROM l)))""",
)
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of reference, uniqueness, range, code, equality and offset rules."""
    t = lambda name: read(spark, sf_dir, name)
    line = t("lineitem")
    w = csr_offsets(spark, sf_dir).withColumn("row", F.col("l_orderkey"))
    # rows of a pool are numbered from 0 without gaps
    numbered = prefix_sum(w.select("l_orderkey", "n", "first", F.lit(1).alias("one")), "one", "l_orderkey", "row")
    return (
        Rules()
        .ref("line_order_exists", line, "l_orderkey", t("orders"), "o_orderkey")
        .ref("line_supplier_exists", line, "l_suppkey", t("supplier").where("s_acctbal > 0"), "s_suppkey")
        .ref("nation_region_exists", t("nation"), "n_regionkey", t("region"), "r_regionkey")
        .unique("line_unique", line, ["l_orderkey", "l_suppkey"])
        .must("quantity_range", "lineitem", line, F.col("l_quantity").between(1, 49))
        .must("discount_range", "lineitem", line, (F.col("l_discount") >= 0) & (F.col("l_discount") < 0.1))
        .must("flag_code", "lineitem", line, F.col("l_returnflag").isin("A", "N"))
        .equal("totals_equal", t("customer").select("c_nationkey"), t("nation").select("n_nationkey"))
        .csr("offsets", numbered, "row", "first", "n")
        # the same with faults put in: a moved offset is wrong itself, and makes the next one wrong
        .csr("offsets_moved", numbered.withColumn("first", F.col("first") + (F.col("row") % 100 == 50).cast("long")), "row", "first", "n")
        .report()
    )


@query(
    "conservation",
    """SELECT (SELECT CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) FROM orders) AS total,
    (SELECT CAST(sum(s) AS BIGINT) FROM (SELECT n_name, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)) AS by_nation""",
)
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nations have adds up to what there is."""
    o = read(spark, sf_dir, "orders").withColumn("cents", cents(F.col("o_totalprice")))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("cents").alias("s"))
    return o.agg(F.sum("cents").alias("total")).join(parts.agg(F.sum("s").alias("by_nation")))


@query("zone_facility_map", "SELECT s_nationkey AS zone, CAST(floor(s_acctbal / 2000) AS BIGINT) AS kind, count(*) AS n FROM supplier GROUP BY ALL")
def zone_facility_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facilities by zone and kind, from a map that each zone carries."""
    kinds = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("zone"), F.floor(F.col("s_acctbal") / 2000).cast("long").alias("kind")).count()
    maps = kinds.groupBy("zone").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("m"))
    return maps.select("zone", F.explode("m").alias("kind", "n"))


@query(
    "zone_links",
    """SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, o_orderstatus AS kind, count(*) AS n, min(CAST(round(o_totalprice * 100) AS BIGINT)) AS least_cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""",
)
def zone_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of zones that something connects. Keys are joined before lines, so that lines move once."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("cents"))
    o = o.join(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    both = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("c_nationkey") != F.col("s_nationkey"))
    a, b = F.least("c_nationkey", "s_nationkey"), F.greatest("c_nationkey", "s_nationkey")
    return both.groupBy(a.alias("a"), b.alias("b"), F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"), F.min("cents").alias("least_cents"))


@query("quantile_report", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY l_returnflag")
def quantile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles with linear interpolation, infinities left out."""
    finite = read(spark, sf_dir, "lineitem").where(F.abs("l_extendedprice") < float("inf"))
    out = quantiles(finite, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("l_returnflag", *(F.round(n, 4).alias(n) for n in ("p50", "p90", "p99")))


@query("density_check", "SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS positive, CASE WHEN count(*) FILTER (c_acctbal < -900) = 0 THEN NULL ELSE 100 * count(*) FILTER (c_acctbal > 0) // count(*) FILTER (c_acctbal < -900) END AS percent FROM customer GROUP BY c_nationkey")
def density_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A percentage without a value where there is nothing to compare with."""
    pos, low = F.count_if(F.col("c_acctbal") > 0), F.count_if(F.col("c_acctbal") < -900)
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), pos.alias("positive"), F.floor(F.try_divide(100 * pos, low)).cast("long").alias("percent"))


@query("set_difference", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one part that the other has not."""
    o = read(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'O'").select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'"), "o_custkey", "left_anti").select("o_custkey")


@query(
    "reexport_diff",
    """SELECT 'only_a' AS side, o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT')
    UNION ALL SELECT 'only_b', o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT' EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000)""",
)
def reexport_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports as multisets, compared both ways in one aggregate instead of two."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    a, b = (o.where("o_totalprice > 100000").withColumn("w", F.lit(1)), o.where("o_orderpriority <> '1-URGENT'").withColumn("w", F.lit(-1)))
    n = a.unionByName(b).groupBy("o_custkey", "o_orderstatus").agg(F.sum("w").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "only_a").otherwise("only_b")
    return n.select(side.alias("side"), "o_custkey", "o_orderstatus", F.explode(F.sequence(F.lit(1), F.abs("n")))).drop("col")
