"""Rules between tables, compiled by what they need: all that need the same join, grouping or order are answered in one pass.

A rule is declared for a table; nothing runs before ``report``. Rules on rows that look up
other tables share one chain of joins a table, whatever they look up; rules on groups
share one aggregate for each key, rules on neighbours one ordering for each order, and
rules on whole tables one aggregate a table. Rows that a rule is unknown for violate it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rows looked at together where each is compared with the one before.
BLOCK = 65536

Row = Callable[[str], Column]


@dataclass
class CrossRules:
    """``tables`` by name, and the rules declared on them."""

    tables: dict[str, DataFrame]
    _rows: dict[str, list] = field(default_factory=dict)
    _groups: dict[tuple, list] = field(default_factory=dict)
    _orders: dict[tuple, list] = field(default_factory=dict)
    _totals: dict[tuple, list] = field(default_factory=dict)
    _whole: dict[str, list] = field(default_factory=dict)

    def row(self, name: str, table: str, holds: Callable[[Row], Column], **lookups: tuple[str, str, str]) -> CrossRules:
        """Of each row: ``holds(c)``, where c("x") is a column and c("zone.x") one of the row that lookup ``zone`` = (column, table, its key) refers to, null if there is none."""
        self._rows.setdefault(table, []).append((name, holds, lookups))
        return self

    def group(self, name: str, table: str, by: list[str], holds: Callable[[], Column]) -> CrossRules:
        """Of each group of rows: a condition on aggregates."""
        self._groups.setdefault((table, *by), []).append((name, holds))
        return self

    def ascending(self, name: str, table: str, row: str, keys: list[str]) -> CrossRules:
        """Each row's keys come after those of the row before, by the row number ``row``."""
        self._orders.setdefault((table, row), []).append((name, keys))
        return self

    def total(self, name: str, table: str, by: str, sum_: str, of: str, key: str, column: str) -> CrossRules:
        """Each row of table ``of`` has in ``column`` the sum over the rows of ``table`` whose ``by`` is its ``key``; rows that refer to none of them violate too."""
        self._totals.setdefault((table, by, of, key), []).append((name, sum_, column))
        return self

    def whole(self, name: str, table: str, holds: Callable[[], Column]) -> CrossRules:
        """Of the table: a condition on aggregates."""
        self._whole.setdefault(table, []).append((name, holds))
        return self

    def report(self) -> DataFrame:
        """(check_name, violations) of every rule."""
        passes = [*map(self._row_pass, self._rows), *map(self._group_pass, self._groups), *map(self._order_pass, self._orders), *map(self._total_pass, self._totals), *map(self._whole_pass, self._whole)]
        return reduce(DataFrame.unionByName, passes)

    @staticmethod
    def _counted(rows: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
        one = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(named)))
        pairs = F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations")) for i, (n, _) in enumerate(named)))
        return one.select(F.explode(pairs).alias("x")).select("x.*")

    def _row_pass(self, table: str) -> DataFrame:
        rules = self._rows[table]
        wanted = {k: v for _, _, lookups in rules for k, v in lookups.items()}
        rows = self.tables[table].select(F.struct("*").alias("_"))
        for name, (column, other, key) in wanted.items():
            there = self.tables[other].select(F.col(key).alias("_k"), F.struct("*").alias(name))
            rows = rows.join(there, F.col(f"_.{column}") == F.col("_k"), "left").drop("_k")
        cell: Row = lambda c: F.col(c if "." in c else f"_.{c}")
        return self._counted(rows, [(n, holds(cell)) for n, holds, _ in rules])

    def _group_pass(self, of: tuple) -> DataFrame:
        table, *by = of
        rules = self._groups[of]
        groups = self.tables[table].groupBy(*by).agg(*(holds().alias(f"h{i}") for i, (_, holds) in enumerate(rules)))
        return self._counted(groups, [(n, F.col(f"h{i}")) for i, (n, _) in enumerate(rules)])

    def _order_pass(self, of: tuple) -> DataFrame:
        table, row = of
        rules = self._orders[of]
        block = F.floor(F.col(row) / BLOCK)
        used = sorted({k for _, keys in rules for k in keys})
        rows = self.tables[table].select(F.col(row).alias("_n"), F.struct(*used).alias("_k"), block.alias("_b"))
        # the first row of a block is compared with the last of the block before, whatever numbers lie between; a row for each block
        ends = rows.groupBy("_b").agg(F.max_by("_k", "_n").alias("_last"))
        ends = ends.select("_b", F.lag("_last").over(W.Window.partitionBy(F.lit(1)).orderBy("_b")).alias("_last"))
        before = F.lag("_k").over(W.Window.partitionBy("_b").orderBy("_n"))
        rows = rows.withColumn("_p", before).join(ends, "_b").withColumn("_p", F.coalesce("_p", "_last"))
        part = lambda s, keys: F.struct(*(F.col(f"{s}.{k}") for k in keys))
        return self._counted(rows, [(n, F.col("_p").isNull() | (part("_p", keys) < part("_k", keys))) for n, keys in rules])

    def _total_pass(self, of: tuple) -> DataFrame:
        table, by, other, key = of
        rules = self._totals[of]
        sums = self.tables[table].where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_k")).agg(*(F.sum(s).alias(f"s{i}") for i, (_, s, _) in enumerate(rules)))
        there = self.tables[other].select(F.col(key).alias("_o"), *(F.col(c).alias(f"w{i}") for i, (_, _, c) in enumerate(rules)))
        both = sums.join(there, F.col("_k") == F.col("_o"), "full")
        return self._counted(both, [(n, F.col("_o").isNotNull() & (F.coalesce(f"s{i}", F.lit(0)) == F.col(f"w{i}"))) for i, (n, _, _) in enumerate(rules)])

    def _whole_pass(self, table: str) -> DataFrame:
        rules = self._whole[table]
        one = self.tables[table].agg(*(holds().alias(f"h{i}") for i, (_, holds) in enumerate(rules)))
        return self._counted(one, [(n, F.col(f"h{i}")) for i, (n, _) in enumerate(rules)])


#: What the shares of a building's uses add up to, and how far rounding may take them off; centimetres that an arc may be shorter than the straight line; centimetres that a point may lie off its zone.
SHARE_ONE, SHARE_OFF, ARC_OFF, ZONE_OFF = 10_000, 40, 20, 100
DAY = 86_400
SHARES = "residential work retail education medical transport control other".split()


def city_rules(tables: dict[str, DataFrame], zone_cm: int = 100_000) -> CrossRules:
    """The rules of a city package, of those tables that are there.

    buildings (row, zone, x_cm, y_cm, residents, road_node_depart, road_node_arrive, function from 0 = unknown, share_*), zones
    (row, ix, iy, residents; columns of the package's own plane), road_nodes (row, osm_id, x_cm, y_cm), road_arcs (row, source, to, way_id, way_part, reverse,
    by_edge, length_cm, car, pedestrian, bridge, tunnel, layer), stops (row, osm_id, zone, x_cm, y_cm), facility_buildings (facility, building),
    transit_periods (row, start_s, end_s) and transit_headways (mode, period).
    """
    r = CrossRules(tables)
    has = lambda *names: all(n in tables for n in names)
    for name in (n for n in ("buildings", "stops") if has(n, "zones")):
        off = lambda c, at, cell: F.greatest(c(f"zone.{cell}") * zone_cm - c(at), c(at) - (c(f"zone.{cell}") + 1) * zone_cm, F.lit(0)).cast("double")
        near = lambda c: off(c, "x_cm", "ix") * off(c, "x_cm", "ix") + off(c, "y_cm", "iy") * off(c, "y_cm", "iy") <= ZONE_OFF * ZONE_OFF
        r.row(f"{name}: point in its zone", name, lambda c, near=near: c("zone").isNull() | near(c), zone=("zone", "zones", "row"))
    if has("buildings"):
        shares = [f"share_{s}" for s in SHARES]
        total = lambda c: sum((c(s) for s in shares), F.lit(0))
        r.row("buildings: nobody outside zones", "buildings", lambda c: c("zone").isNotNull() | (c("residents") == 0))
        r.row("buildings: road both ways or none", "buildings", lambda c: c("road_node_depart").isNull() == c("road_node_arrive").isNull())
        r.row("buildings: unknown use without shares", "buildings", lambda c: (c("function") != 0) | (total(c) == 0))
        r.row("buildings: shares make one", "buildings", lambda c: (c("function") == 0) | (F.abs(total(c) - SHARE_ONE) <= SHARE_OFF))
        r.row("buildings: use of the greatest share", "buildings", lambda c: (c("function") == 0) | (F.get(F.array(*map(c, shares)), c("function").cast("int") - 1) == F.greatest(*map(c, shares))))
        r.whole("buildings: ids for all residents", "buildings", lambda: F.coalesce(F.sum("residents"), F.lit(0)) < 1 << 31)
    if has("buildings", "zones"):
        r.total("zones: residents of their buildings", "buildings", "zone", "residents", "zones", "row", "residents")
    if has("zones"):
        r.ascending("zones: in order of cells", "zones", "row", ["ix", "iy"])
    for name in (n for n in ("stops", "road_nodes") if has(n)):
        r.ascending(f"{name}: in order of ids", name, "row", ["osm_id"])
    if has("road_arcs"):
        edge = ["way_id", "way_part"]
        one = lambda c: F.min(c) == F.max(c)
        alike = ("road_class", "length_cm", "bridge", "tunnel", "layer")
        r.ascending("road_arcs: in order of ends and ways", "road_arcs", "row", ["source", "to", *edge, "reverse"])
        r.group("road_arcs: two ways of each edge", "road_arcs", edge, lambda: (F.count("*") == 2) & (F.sum("reverse") == 1))
        r.group("road_arcs: both between the same ends", "road_arcs", edge, lambda: one(F.least("source", "to")) & one(F.greatest("source", "to")) & (F.count_if(F.col("source") == F.col("to")).isin(0, 2)) & ((F.count_distinct("source") == 2) | one("to")))
        r.group("road_arcs: both alike", "road_arcs", edge, lambda: reduce(lambda a, b: a & b, (one(c) for c in alike if c in tables["road_arcs"].columns)))
        r.group("road_arcs: by_edge names each once", "road_arcs", ["by_edge"], lambda: F.count("*") == 1)
        r.whole("road_arcs: by_edge from 0 on", "road_arcs", lambda: (F.count("*") == 0) | ((F.min("by_edge") == 0) & (F.max("by_edge") == F.count("*") - 1)))
        r.row("road_arcs: no cars on footways", "road_arcs", lambda c: ~c("pedestrian") | (c("car") == 0))
    if has("road_arcs", "road_nodes"):
        span = lambda c, k: (c(f"head.{k}") - c(f"tail.{k}")).cast("double")
        straight = lambda c: F.sqrt(span(c, "x_cm") * span(c, "x_cm") + span(c, "y_cm") * span(c, "y_cm"))
        r.row("road_arcs: no shorter than straight", "road_arcs", lambda c: c("length_cm") >= straight(c) - ARC_OFF, tail=("source", "road_nodes", "row"), head=("to", "road_nodes", "row"))
    if has("facility_buildings"):
        r.group("facilities: each building once", "facility_buildings", ["facility", "building"], lambda: F.count("*") == 1)
    if has("transit_periods"):
        # each begins where one ends, and together they are a day
        length = F.pmod(F.col("end_s") - F.col("start_s") - 1, F.lit(DAY)) + 1
        r.whole("periods: make a day", "transit_periods", lambda: F.sum(length) == DAY)
        r.row("periods: begin where one ends", "transit_periods", lambda c: c("before.end_s").isNotNull(), before=("start_s", "transit_periods", "end_s"))
    if has("transit_headways"):
        r.group("headways: each mode and period once", "transit_headways", ["mode", "period"], lambda: F.count("*") == 1)
    if has("transit_headways", "transit_periods"):
        r.row("headways: of a period", "transit_headways", lambda c: c("of.row").isNotNull(), of=("period", "transit_periods", "row"))
    return r
