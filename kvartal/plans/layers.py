"""Map layers, tags, sets, shares, cards of persons and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.functions import tags
from kvartal.functions.rounding import cents
from kvartal.plans.registry import query
from kvartal.sources.tables import read

#: Values that stand for tags in the driver's tables.
_VALUES = ["school", "bank", "no", "apartments", "office", "train_station", "kiosk"]


def _case(col: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + f" ELSE {other} END"


_TAG = f"CASE k WHEN {' WHEN '.join(f'{i} THEN {v!r}' for i, v in enumerate(_VALUES))} END"
_USE = "coalesce({}, CASE WHEN office IS NOT NULL THEN 'work' END, CASE WHEN shop IS NOT NULL THEN 'retail' END, 'other')"


@query(
    "building_use",
    f"SELECT p_partkey AS id, {_USE.format(_case('amenity', tags.USES['amenity']) + ', ' + _case('building', tags.USES['building']))} AS use FROM (SELECT p_partkey, {_TAG.replace('CASE k', 'CASE p_partkey % 11')} AS amenity, {_TAG.replace('CASE k', 'CASE p_partkey % 13')} AS building, {_TAG.replace('CASE k', 'CASE p_partkey % 17')} AS office, {_TAG.replace('CASE k', 'CASE p_partkey % 9')} AS shop FROM part)",
)
def building_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a building is used for, by the first key that tells."""
    k = F.col("p_partkey")
    tag = lambda n: F.get(F.array(*map(F.lit, _VALUES)), (k % n).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("id"), tags.use({"amenity": tag(11), "building": tag(13), "office": tag(17), "shop": tag(9)}).alias("use"))


_WATER = ["river", "canal", "stream", "ditch", None]
_RAIL = ["rail", "narrow_gauge", "tram", "light_rail", "monorail", "subway", None]
_LAND = ["forest", "grass", "reservoir", "retail", "railway", "orchard", "residential", "cemetery", "village_green", "quarry", None]
_NATURE = ["wood", "heath", "water", "cliff", None, None, None]
_PLAY = ["park", "pitch", "garden", None, None, None, None, None]


def _nth(values: list, k: str) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END"


def _tag(values: list) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("p_partkey") % len(values)).cast("int"))


@query(
    "line_classes",
    f"""SELECT id, class, CASE WHEN bridge THEN greatest(1, least(5, layer)) ELSE 0 END AS level FROM (SELECT p_partkey AS id, p_size % 3 = 0 AS bridge,
    CAST(CASE WHEN p_partkey % 15 - 7 BETWEEN -5 AND 5 THEN p_partkey % 15 - 7 ELSE 0 END AS INTEGER) AS layer,
    CASE WHEN p_partkey % 10 <> 0 THEN CASE WHEN water IN ('river', 'canal') THEN 'river' WHEN water = 'stream' THEN 'stream' WHEN rail = 'rail' AND p_partkey % 4 > 0 THEN 'rail_minor' WHEN rail = 'rail' THEN 'rail'
    WHEN rail = 'narrow_gauge' THEN 'rail_minor' WHEN rail IN ('tram', 'light_rail', 'monorail') THEN 'tram' END END AS class
    FROM (SELECT *, {_nth(_WATER, "p_partkey")} AS water, {_nth(_RAIL, "p_partkey")} AS rail FROM part)) WHERE class IS NOT NULL""",
)
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn lines with class and level: waters and rails, no tunnels."""
    k = F.col("p_partkey")
    class_ = tags.line_class({"waterway": _tag(_WATER), "railway": _tag(_RAIL), "service": F.when(k % 4 > 0, "yard").otherwise(""), "tunnel": F.when(k % 10 == 0, "culvert").when(k % 3 == 0, "no")})
    level = tags.bridge_level(tags.layer((k % 15 - 7).cast("string")), F.col("p_size") % 3 == 0)
    return read(spark, sf_dir, "part").select(k.alias("id"), class_.alias("class"), level.alias("level")).where("class IS NOT NULL")


@query(
    "area_classes",
    f"""SELECT id, CASE WHEN nature = 'water' OR water = 'riverbank' OR land = 'reservoir' THEN 'water' WHEN land = 'forest' OR nature = 'wood' THEN 'forest' WHEN play IN ('park', 'garden') OR land = 'village_green' THEN 'park'
    WHEN land = 'grass' OR nature = 'heath' THEN 'grass' WHEN land = 'cemetery' THEN 'cemetery' WHEN land = 'railway' THEN 'industrial' WHEN land = 'retail' THEN 'commercial' WHEN land = 'residential' THEN 'residential' WHEN land = 'orchard' THEN 'farmland' END AS class
    FROM (SELECT p_partkey AS id, {_nth(_LAND, "p_partkey")} AS land, {_nth(_NATURE, "p_partkey")} AS nature, {_nth(_PLAY, "p_partkey")} AS play, CASE WHEN p_partkey % 13 = 0 THEN 'riverbank' END AS water FROM part)""",
)
def area_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of areas, null where none is drawn."""
    k = F.col("p_partkey")
    of = {"landuse": _tag(_LAND), "natural": _tag(_NATURE), "leisure": _tag(_PLAY), "waterway": F.when(k % 13 == 0, "riverbank")}
    return read(spark, sf_dir, "part").select(k.alias("id"), tags.area_class(of).alias("class"))


@query(
    "stop_kinds",
    "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 1 OR s_suppkey % 8 = 3 THEN 'station' WHEN s_suppkey % 3 = 2 OR s_suppkey % 8 IN (1, 2, 4) THEN 'stop_position' ELSE 'platform' END AS kind FROM supplier",
)
def stop_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations, stopping places and platforms."""
    k = F.col("s_suppkey")
    public = F.when(k % 3 == 0, "platform").when(k % 3 == 1, "station").otherwise("stop_position")
    rail = F.get(F.array(*(F.lit(v).cast("string") for v in ("platform", "halt", "stop", "station", "tram_stop", None, None, None))), (k % 8).cast("int"))
    return read(spark, sf_dir, "supplier").select(k.alias("id"), tags.stop_kind(public, rail).alias("kind"))


@query(
    "list_members",
    "SELECT p_partkey AS id, trim(x) AS word, trim(x) = 'STEEL' AS steel FROM (SELECT p_partkey, unnest(string_split(replace(p_type, ' ', ' ; ') || ';', ';')) AS x FROM part) WHERE trim(x) <> ''",
)
def list_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of lists that semicolons part."""
    text = F.concat(F.replace("p_type", F.lit(" "), F.lit(" ; ")), F.lit(";"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(tags.parts(text)).alias("word")).withColumn("steel", F.col("word") == "STEEL")


@query("short_names", "SELECT s_suppkey AS id, regexp_replace(regexp_replace('Long Street Square ' || s_name, '(?i)\\bstreet\\b', 'st.', 'g'), '(?i)\\bsquare\\b', 'sq.', 'g') AS name FROM supplier")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as labels shorten them."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), tags.abbreviate(F.concat(F.lit("Long Street Square "), "s_name")).alias("name"))


@query("normalised_shares", "SELECT p_partkey AS id, list_transform([a, b, c], lambda x: x / ((a + b) + c)) AS shares FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey % 7 AS DOUBLE) AS b, CAST(p_partkey % 3 AS DOUBLE) AS c FROM part)")
def normalised_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a building's uses, scaled to one."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("id"), tags.normalise(F.array(F.col("p_size").cast("double"), (k % 7).cast("double"), (k % 3).cast("double"))).alias("shares"))


@query("linked_union", "SELECT id, min(origin) AS origin FROM (SELECT o_custkey AS id, 1 AS origin FROM orders UNION ALL SELECT c_custkey, 2 FROM customer UNION ALL SELECT s_suppkey, 3 FROM supplier) GROUP BY id")
def linked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of three sources, each once, from the first source that has it."""
    of = lambda t, c, n: read(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(n).alias("origin"))
    return of("orders", "o_custkey", 1).union(of("customer", "c_custkey", 2)).union(of("supplier", "s_suppkey", 3)).groupBy("id").agg(F.min("origin").alias("origin"))


@query("linked_ids", "SELECT l_orderkey AS id, string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)) AS ids FROM (SELECT l_orderkey, l_partkey AS x FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey")
def linked_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids that an object is linked with, each once."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.explode(F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("x"))
    return li.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias("ids"))


@query("tile_sets_equal", "SELECT count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed FROM (SELECT DISTINCT c_nationkey AS a FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey AS b FROM supplier) ON a = b")
def tile_sets_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one set of tiles has beyond another, either way: equal sets give zeros."""
    a = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("t")).distinct().withColumn("a", F.lit(True))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("t")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "t", "full").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"))


@query(
    "population_checks",
    "SELECT (SELECT coalesce(CAST(sum(n - 1) AS BIGINT), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate)) AS repeated, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS lost, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 25 <> c_nationkey) AS other_zone",
)
def population_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beside their buildings: repeated ones, ones without a building, ones of another zone."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    repeated = o.groupBy("o_custkey", "o_orderdate").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    both = o.select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    rest = both.agg(F.count_if(F.col("c_custkey").isNull()).alias("lost"), F.count_if(F.col("c_custkey").isNotNull() & (F.col("o_orderkey") % 25 != F.col("c_nationkey"))).alias("other_zone"))
    return repeated.crossJoin(rest)  # one row each


@query(
    "population_report",
    "SELECT g, n, share_bp, abs(share_bp - 2000) AS off_bp, max(abs(share_bp - 2000)) OVER () AS most_bp FROM (SELECT c_mktsegment AS g, count(*) AS n, count(*) * 10000 // (SELECT count(*) FROM customer) AS share_bp FROM customer GROUP BY c_mktsegment)",
)
def population_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of groups against even ones, with the furthest deviation."""
    g = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("g")).agg(F.count("*").alias("n"))
    all_ = g.agg(F.sum("n").alias("all"))
    share = g.crossJoin(F.broadcast(all_)).select("g", "n", F.floor(F.col("n") * 10000 / F.col("all")).cast("long").alias("share_bp"))
    off = share.withColumn("off_bp", F.abs(F.col("share_bp") - 2000))
    return off.crossJoin(F.broadcast(off.agg(F.max("off_bp").alias("most_bp"))))


@query(
    "route_summary",
    "SELECT level, count(*) AS tiles, CAST(sum(b) AS BIGINT) // count(*) AS mean, min(b) AS least, max(b) AS most, CAST(2 * median(b) AS BIGINT) AS median2 FROM (SELECT o_orderkey % 5 AS level, CAST(round(o_totalprice * 100) AS BIGINT) AS b FROM orders) GROUP BY level",
)
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least, most and median bytes of the tiles of each level; the median by ranks, counted before."""
    o = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("level"), cents(F.col("o_totalprice")).alias("b"))
    per = o.groupBy("level", "b").agg(F.count("*").alias("n"))
    w = W.Window.partitionBy("level").orderBy("b")
    ranked = per.withColumn("upto", F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, 0)))
    all_ = per.groupBy("level").agg(F.sum("n").alias("tiles"), F.sum(F.col("n") * F.col("b")).alias("total"), F.min("b").alias("least"), F.max("b").alias("most"))
    mid = ranked.join(all_, "level").where((F.col("upto") >= F.floor((F.col("tiles") + 1) / 2)) & (F.col("upto") - F.col("n") < F.floor((F.col("tiles") + 2) / 2)))
    # one value holds both middle ranks, or two neighbours hold one each
    median2 = F.min("b") + F.max("b")
    return mid.groupBy("level", "tiles", "total", "least", "most").agg(median2.alias("median2")).select("level", "tiles", F.floor(F.col("total") / F.col("tiles")).cast("long").alias("mean"), "least", "most", "median2")


@query(
    "route_ways",
    "SELECT l_partkey AS way, count(DISTINCT l_orderkey) AS routes, min(o_orderpriority) AS mode FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus <> 'P' AND p_size > 10 GROUP BY l_partkey",
)
def route_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawable ways that routes in service lead over."""
    live = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    ways = read(spark, sf_dir, "part").where("p_size > 10").select("p_partkey")
    m = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(live, F.col("l_orderkey") == F.col("o_orderkey")).join(ways, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return m.groupBy(F.col("l_partkey").alias("way")).agg(F.countDistinct("l_orderkey").alias("routes"), F.min("o_orderpriority").alias("mode"))


@query("overview_points", "SELECT l_suppkey AS stop, CAST(bit_or(1 << (l_linenumber % 8)) AS INTEGER) AS modes FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0 GROUP BY l_suppkey")
def overview_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops inside the region with a mask of the modes that serve them."""
    inside = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    bit = F.call_function("shiftleft", F.lit(1), (F.col("l_linenumber") % 8).cast("int"))
    return read(spark, sf_dir, "lineitem").join(inside, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").groupBy(F.col("l_suppkey").alias("stop")).agg(F.bit_or(bit).cast("int").alias("modes"))


@query(
    "package_layers",
    "SELECT c_custkey AS building, coalesce(n, 0) AS residents, coalesce(f, '') AS facilities FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN (SELECT s_suppkey % 1000 AS b, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS f FROM supplier GROUP BY s_suppkey % 1000) ON b = c_custkey",
)
def package_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with their residents and facilities."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("building"))
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("building")).agg(F.count("*").alias("n"))
    f = read(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 1000).alias("building")).agg(F.array_join(F.array_sort(F.collect_list(F.col("s_suppkey").cast("string"))), ",").alias("f"))
    return c.join(n, "building", "left").join(f, "building", "left").select("building", F.coalesce("n", F.lit(0)).alias("residents"), F.coalesce("f", F.lit("")).alias("facilities"))


_L = "l AS (SELECT o_orderpriority AS name, o_custkey AS x, o_custkey + o_orderkey % 50 AS x2, CAST(round(o_totalprice) AS BIGINT) AS len FROM orders)"


@query("lines_by_name", f"WITH {_L} SELECT name, count(*) AS n, CAST(sum(len) AS BIGINT) AS length, min(x) AS lo, max(x2) AS hi FROM l WHERE x <= 900 AND x2 >= 100 GROUP BY name")
def lines_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that touch a box, by name, with length and extent."""
    length = F.floor(F.col("o_totalprice") + 0.5).cast("long")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("x"), (F.col("o_custkey") + F.col("o_orderkey") % 50).alias("x2"), length.alias("len"))
    return o.where("x <= 900 AND x2 >= 100").groupBy("name").agg(F.count("*").alias("n"), F.sum("len").alias("length"), F.min("x").alias("lo"), F.max("x2").alias("hi"))


@query("region_labels", "SELECT o_custkey AS id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS length FROM orders GROUP BY o_custkey HAVING sum(CAST(round(o_totalprice * 100) AS BIGINT)) >= CASE WHEN o_custkey % 3 = 0 THEN 100000000 ELSE 50000000 END")
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is large enough for a label, by the least of its kind."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(cents(F.col("o_totalprice"))).alias("length"))
    return o.where(F.col("length") >= F.when(F.col("id") % 3 == 0, 100_000_000).otherwise(50_000_000))


@query("detail_levels", "SELECT level, count(*) AS n FROM (VALUES (0, 40), (1, 25), (2, 10), (3, 0)) r(level, least) JOIN part ON p_size >= least GROUP BY level")
def detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each level of detail shows: what is not below its least size. Counted by size before rules are looked at."""
    sizes = read(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    shown = F.array(*(F.when(F.col("p_size") >= least, F.lit(level)) for level, least in ((0, 40), (1, 25), (2, 10), (3, 0))))
    return sizes.select("n", F.explode(F.array_compact(shown)).alias("level")).groupBy("level").agg(F.sum("n").alias("n"))


@query("gateway_candidates", "WITH q AS (SELECT l_orderkey AS route, l_linenumber AS no, l_suppkey AS stop, l_suppkey % 10 = 0 AS outside, lag(l_suppkey % 10 = 0) OVER w AS before, lead(l_suppkey % 10 = 0) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey)) SELECT DISTINCT route, stop FROM q WHERE NOT outside AND (coalesce(before, false) OR coalesce(after, false))")
def gateway_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of a route next to one outside the region."""
    w = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    out = F.col("l_suppkey") % 10 == 0
    beside = F.coalesce(F.lag(out).over(w), F.lit(False)) | F.coalesce(F.lead(out).over(w), F.lit(False))
    q = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", out.alias("out"), beside.alias("beside"))
    return q.where(~F.col("out") & F.col("beside")).select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("stop")).distinct()


@query("gateway_rule", "SELECT o_orderkey AS route, o_custkey % 100 AS stop FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 100 AND l_linenumber % 2 = o_custkey % 2)")
def gateway_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gateways that are no stop of their route and mode."""
    g = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), (F.col("o_custkey") % 100).alias("stop"), (F.col("o_custkey") % 2).alias("mode"))
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_suppkey").alias("stop"), (F.col("l_linenumber") % 2).cast("long").alias("mode"))
    return g.join(s, ["route", "stop", "mode"], "left_anti").select("route", "stop")


@query("area_members", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 20 = b.s_suppkey % 20 AND a.s_suppkey < b.s_suppkey")
def area_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of members of one stop area, each once: the pairs are the result, areas are small."""
    s = read(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 20).alias("part"), "s_suppkey")
    other = s.select("s_nationkey", "part", F.col("s_suppkey").alias("b"))
    return s.join(other, ["s_nationkey", "part"]).where("s_suppkey < b").select(F.col("s_suppkey").alias("a"), "b")


_CAP = "SELECT s_nationkey AS block, s_suppkey AS place, CAST(floor(greatest(s_acctbal, 0) / 100) AS BIGINT) AS area FROM supplier"


@query(
    "place_capacities",
    f"WITH s AS ({_CAP}), m AS (SELECT CAST(median(area) AS BIGINT) AS med FROM s WHERE area > 0) SELECT block, place, c AS capacity FROM (SELECT block, place, CASE WHEN place % 10 = 0 THEN med * 110 // 100 ELSE area * 110 // 100 END AS c FROM s, m) WHERE c > 0",
)
def place_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats of places by floor area with slack; the median where the area is not known, none dropped but those with none."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_suppkey").alias("place"), F.floor(F.greatest(F.col("s_acctbal"), F.lit(0)) / 100).cast("long").alias("area"))
    # ranks over counted areas: the middle one, or the two middle ones
    per = s.where("area > 0").groupBy("area").agg(F.count("*").alias("n"))
    med = per.agg(F.percentile("area", 0.5, F.col("n")).alias("m")).select(F.rint("m").cast("long").alias("med"))
    c = F.floor(F.when(F.col("place") % 10 == 0, F.col("med")).otherwise(F.col("area")) * 110 / 100).cast("long")
    return s.crossJoin(F.broadcast(med)).select("block", "place", c.alias("capacity")).where("capacity > 0")


_BL = "c AS (SELECT c_custkey AS id, c_nationkey AS block, c_custkey * 7919 % 20011 AS x, c_custkey * 5003 % 19993 AS y FROM customer)"


@query(
    "block_representatives",
    f"WITH {_BL}, m AS (SELECT block, CAST(sum(x) AS BIGINT) // count(*) AS mx, CAST(sum(y) AS BIGINT) // count(*) AS my FROM c GROUP BY block) SELECT block, arg_min(id, ((x - mx) * (x - mx) + (y - my) * (y - my), id)) AS id FROM c JOIN m USING (block) WHERE id % 4 <> 0 GROUP BY block",
)
def block_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each block the building with a road that is nearest its centre."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("block"), (k * 7919 % 20011).alias("x"), (k * 5003 % 19993).alias("y"))
    m = c.groupBy("block").agg(F.floor(F.sum("x") / F.count("*")).alias("mx"), F.floor(F.sum("y") / F.count("*")).alias("my"))
    d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
    return c.where("id % 4 <> 0").join(m, "block").groupBy("block").agg(F.min_by("id", F.struct(d2, "id")).alias("id"))


@query("within_block_time", "SELECT n_nationkey AS block, CAST(min(abs(b - n_nationkey)) * 60 // 2 AS BIGINT) AS seconds FROM nation JOIN (SELECT DISTINCT s_nationkey AS b FROM supplier) ON b <> n_nationkey GROUP BY n_nationkey")
def within_block_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the time to the nearest other block that can be reached, by neighbours in the order of blocks."""
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("b")).distinct().withColumn("to", F.lit(True))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("b"), F.lit(True).alias("own")).join(b, "b", "full")
    # one row a block: the order is of the catalogue of blocks
    w = W.Window.partitionBy(F.lit(0)).orderBy("b")
    to = F.when(F.col("to"), F.col("b"))
    back = F.last(to, True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    ahead = F.first(to, True).over(w.rowsBetween(1, W.Window.unboundedFollowing))
    near = n.select("b", "own", F.least(F.col("b") - back, ahead - F.col("b")).alias("d"))
    return near.where("own AND d IS NOT NULL").select(F.col("b").alias("block"), F.floor(F.col("d") * 60 / 2).cast("long").alias("seconds"))


@query("end_stop_choice", "SELECT o_orderkey AS trip, arg_min(l_suppkey, (l_linenumber * 100 + l_suppkey % 37 * 10, l_suppkey)) AS stop, CAST(min(l_linenumber * 100 + l_suppkey % 37 * 10) AS BIGINT) AS cost FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def end_stop_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to get off: the stop of least ride and walk, then of least id."""
    cost = (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 37 * 10).cast("long")
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip")).agg(F.min(F.struct(cost.alias("cost"), F.col("l_suppkey").alias("stop"))).alias("m"))
    return li.select("trip", "m.stop", "m.cost")


@query("plan_legs", "SELECT l_orderkey AS trip, row_number() OVER w AS leg, l_suppkey AS from_stop, lead(l_suppkey) OVER w AS to_stop, n_name AS at FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) QUALIFY to_stop IS NOT NULL")
def plan_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's rides as legs from stop to stop, with the place where each begins."""
    w = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    legs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.row_number().over(w).cast("long").alias("leg"), F.col("l_suppkey").alias("from_stop"), F.lead("l_suppkey").over(w).alias("to_stop"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("at"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("from_stop"), "s_nationkey").join(F.broadcast(n), "s_nationkey")  # 25 rows
    return legs.where("to_stop IS NOT NULL").join(s, "from_stop").select("trip", "leg", "from_stop", "to_stop", "at")


@query("trip_route", "WITH t AS (SELECT o_custkey AS person, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS trip FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY o_custkey) SELECT person, trip, string_agg(CAST(l_suppkey AS VARCHAR), '>' ORDER BY l_linenumber, l_suppkey) AS route FROM t JOIN lineitem ON l_orderkey = trip GROUP BY person, trip")
def trip_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of everyone's trip at a time: the last that had begun."""
    o = read(spark, sf_dir, "orders").where("o_orderdate <= TIMESTAMP '1998-01-01'")
    t = o.groupBy(F.col("o_custkey").alias("person")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("person", F.col("m.o_orderkey").alias("trip"))
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), "l_linenumber", "l_suppkey").join(t, "trip")
    stops = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return li.groupBy("person", "trip").agg(stops.alias("s")).select("person", "trip", F.array_join(F.transform("s", lambda x: x.l_suppkey.cast("string")), ">").alias("route"))


@query(
    "person_card",
    "SELECT c_custkey AS person, n_name AS home, coalesce(n, 0) AS trips, last, CAST(size AS BIGINT) AS household, e.event_type AS doing FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN (SELECT c_nationkey AS k, c_mktsegment AS m, count(*) AS size FROM customer GROUP BY ALL) ON k = c_nationkey AND m = c_mktsegment LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) e ON e.user_id = c_custkey",
)
def person_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each person: home, household, trips, what they last did."""
    c = read(spark, sf_dir, "customer")
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home"))
    size = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("household"))
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("doing"))
    all_ = c.select("c_custkey", "c_nationkey", "c_mktsegment").join(F.broadcast(n), "c_nationkey").join(size, ["c_nationkey", "c_mktsegment"]).join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return all_.select(F.col("c_custkey").alias("person"), "home", F.coalesce("n", F.lit(0)).alias("trips"), "last", "household", "doing")


@query("resident_endpoints", "SELECT c_custkey AS person, c_nationkey AS home, coalesce(s_nationkey, c_nationkey) AS work, c_acctbal > 5000 AS car FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def resident_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where residents live and work, and whether they have a car; who has no place stays at home."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_nationkey")
    c = read(spark, sf_dir, "customer").join(s, "c_custkey", "left")
    return c.select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("home"), F.coalesce("s_nationkey", "c_nationkey").alias("work"), (F.col("c_acctbal") > 5000).alias("car"))


@query(
    "invariants",
    """SELECT 'home_known' AS check_name, count(*) FILTER (c_nationkey NOT IN (SELECT n_nationkey FROM nation)) AS violations FROM customer UNION ALL
    SELECT 'segment_named', count(*) FILTER (c_mktsegment IS NULL OR c_mktsegment = '') FROM customer UNION ALL
    SELECT 'trip_has_stops', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL
    SELECT 'mask_only_known', count(*) FILTER ((p_size & ~63) <> 0) FROM part UNION ALL
    SELECT 'size_max_or_none', count(*) FILTER (p_size > 45) FROM part UNION ALL
    SELECT 'late_after_order', count(*) FILTER (l_shipdate <= o_orderdate) FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL
    SELECT 'seats_enough', count(*) FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) JOIN supplier ON s_suppkey = l_suppkey WHERE n > 550 + s_suppkey % 100""",
)
def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of population, places and movement over several tables, as rows of a report."""
    from kvartal.operators.rules import Rules

    c, o, li, p = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    used = li.groupBy("l_suppkey").agg(F.count("*").alias("n")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    trips = li.select("l_orderkey", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = Rules().ref("home_known", c, "c_nationkey", read(spark, sf_dir, "nation"), "n_nationkey")
    r.must("segment_named", "customer", c, F.col("c_mktsegment") != "").ref("trip_has_stops", o, "o_orderkey", li.select("l_orderkey").distinct(), "l_orderkey")
    r.mask("mask_only_known", "part", p, "p_size", 63).max_or_none("size_max_or_none", "part", p, "p_size", 45)
    r.must("late_after_order", "trips", trips, F.col("l_shipdate") > F.col("o_orderdate"))
    return r.must("seats_enough", "used", used, F.col("n") <= 550 + F.col("s_suppkey") % 100).report()
