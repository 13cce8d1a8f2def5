"""Joins of points with polygons and segments in whole centimetres, over a grid.

A polygon is a ring: an array of (x, y) whose last corner joins the first. A shape goes to
cells of a side that suits its size, at most 17 by 17 of them, and each point looks into its
cell of every side in use: a shape of a house and one of a country cost as many rows. An
equi-join on side and cell finds the candidates. Cells that no edge comes by lie in the
shape or off it with all their points; in the others an exact test against the edges near
the cell follows. A point on an edge is inside. Rings become edges once, before they meet any point.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.operators.grid import cell
from kvartal.operators.nearest import bits, candidates
from kvartal.scratch import Scratch

#: A shape's box is 8 to 16 cells wide or high, if it is not narrower than the least cells allow.
FINE = 16
_CELL = ["_size", "_ix", "_iy"]
#: Edges of a shape, or of one near a cell, that are compared one by one without a lambda.
FEW = 4


def ring_of(*corners: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")) for x, y in corners))


def edges(ring: Column) -> Column:
    """(a, b) corners of every edge."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _side(x: Column, y: Column, e: Column) -> Column:
    return (e.b.x - e.a.x) * (y - e.a.y) - (x - e.a.x) * (e.b.y - e.a.y)


def _on(x: Column, y: Column, e: Column) -> Column:
    return (_side(x, y, e) == 0) & x.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & y.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))


def _crosses(x: Column, y: Column, e: Column) -> Column:
    return ((e.a.y > y) != (e.b.y > y)) & ((_side(x, y, e) > 0) == (e.b.y > e.a.y))


def _few(edges_: Column, f: Callable[[Column], Column], join: Callable[[Column, Column], Column], many: Column) -> Column:
    """``f`` of every edge joined, written out for a few edges, as Spark compiles that and no lambdas; ``many`` is the same for more."""
    return F.when(F.size(edges_) <= FEW, reduce(join, (F.coalesce(f(F.get(edges_, F.lit(i))), F.lit(False)) for i in range(FEW)))).otherwise(many)


def inside_edges(x: Column, y: Column, edges_: Column) -> Column:
    """Is a point between edges or on one? Exact for coordinates below 2**31."""
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))
    step = lambda s, e: F.struct((s.odd != _crosses(x, y, e)).alias("odd"), (s.on | _on(x, y, e)).alias("on"))
    many = F.aggregate(edges_, start, step, lambda s: s.odd | s.on)
    on = _few(edges_, lambda e: _on(x, y, e), lambda a, b: a | b, F.lit(False))
    return on | _few(edges_, lambda e: _crosses(x, y, e), lambda a, b: a != b, many)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Is a point in a ring or on its edge? Exact for coordinates below 2**31."""
    return inside_edges(x, y, edges(ring))


def double_area(ring: Column) -> Column:
    """Twice the area of a ring."""
    return F.abs(F.aggregate(edges(ring), F.lit(0).cast("long"), lambda s, e: s + e.a.x * e.b.y - e.b.x * e.a.y))


def segment_distance2(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = bx - ax, by - ay
    along, whole = (x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy
    d2 = lambda px, py: ((x - px) * (x - px) + (y - py) * (y - py)).cast("double")
    side = (dx * (y - ay) - (x - ax) * dy).cast("double")
    return F.when(along <= 0, d2(ax, ay)).when(along >= whole, d2(bx, by)).otherwise(side * side / whole)


def edges_distance2(x: Column, y: Column, edges_: Column) -> Column:
    """Squared distance of a point to what edges enclose, 0 inside."""
    each = F.transform(edges_, lambda e: segment_distance2(x, y, e.a.x, e.a.y, e.b.x, e.b.y))
    return F.when(inside_edges(x, y, edges_), F.lit(0.0)).otherwise(F.array_min(each))


def _spread(shapes: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: int) -> DataFrame:
    """Shapes repeated for every cell of their box."""
    out = shapes.withColumn("_ix", F.explode(F.sequence(cell(x[0], size), cell(x[1], size))))
    return out.withColumn("_iy", F.explode(F.sequence(cell(y[0], size), cell(y[1], size))))


def _boxed(shapes: DataFrame) -> DataFrame:
    """Shapes with their box and their edges instead of the ring, computed once."""
    side = lambda f, k: f(F.transform("ring", lambda c: c[k]))
    box = {"x1": side(F.array_min, "x"), "y1": side(F.array_min, "y"), "x2": side(F.array_max, "x"), "y2": side(F.array_max, "y")}
    return shapes.withColumns(box | {"_edges": edges(F.col("ring"))})


def _index(c: Column, n: Column) -> Column:
    return F.floor((c - F.pmod(c, n)) / n).cast("long")


def _cut(e: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Does an edge meet a rectangle?"""
    meets = (F.least(e.a.x, e.b.x) <= x2) & (F.greatest(e.a.x, e.b.x) >= x1) & (F.least(e.a.y, e.b.y) <= y2) & (F.greatest(e.a.y, e.b.y) >= y1)
    sides = [_side(x, y, e) for x in (x1, x2) for y in (y1, y2)]
    return meets & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def _sized(shapes: DataFrame, size: int, far: int) -> tuple[DataFrame, list[int]]:
    """Shapes with edges, box (wider by ``far``) and the side of their cells; the sides in use."""
    boxes = _boxed(shapes).withColumns({f"{c}{i}": F.col(f"{c}{i}") + (far if i == 2 else -far) for c in "xy" for i in (1, 2)})
    level = bits(F.floor(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / size).cast("long"))
    boxes = boxes.withColumn("_size", F.greatest(F.lit(1), F.floor(F.call_function("shiftleft", F.lit(size).cast("long"), level) / FINE)).cast("long"))
    return boxes, [r[0] for r in boxes.select("_size").where("_size IS NOT NULL").distinct().collect()]  # at most one for each binary digit


def _over_cells(boxes: DataFrame, far: int) -> DataFrame:
    """Shapes repeated for every cell of their box.

    ``_whole``: all of the cell lies in the shape. Else ``_edges`` are those that tell which
    points of the cell do. With ``far`` 0, cells that the shape does not reach are left out.
    """
    n, edges_ = F.col("_size"), F.col("_edges")
    # few shapes are many cells: they are dealt to all cores first
    spread = boxes.repartition(boxes.sparkSession.sparkContext.defaultParallelism, "s_id")
    for c in "xy":
        spread = spread.withColumn(f"_i{c}", F.explode(F.sequence(_index(F.col(f"{c}1"), n), _index(F.col(f"{c}2"), n))))
    low, high = [F.col(f"_i{c}") * n for c in "xy"], [F.col(f"_i{c}") * n + n - 1 for c in "xy"]
    at = [F.greatest(low[i], F.col(f"{c}1")) for i, c in enumerate("xy")] + [F.least(high[i], F.col(f"{c}2")) for i, c in enumerate("xy")]
    cut = lambda e: _cut(e, *at)
    # where no edge comes by, one point tells of all
    whole = F.when(~_few(edges_, cut, lambda a, b: a | b, F.exists(edges_, cut)), inside_edges(at[0], at[1], edges_))
    spread = spread.withColumn("_whole", whole)
    if far == 0:
        spread = spread.where(F.coalesce("_whole", F.lit(True)))
        # inside_edges looks to the right along a row
        near = lambda e: (F.least(e.a.y, e.b.y) <= high[1]) & (F.greatest(e.a.y, e.b.y) >= low[1]) & (F.greatest(e.a.x, e.b.x) >= low[0])
        spread = spread.withColumn("_edges", F.when(F.size(edges_) <= FEW, edges_).otherwise(F.filter(edges_, near)))
    whole = F.coalesce("_whole", F.lit(False))
    return spread.withColumns({"_whole": whole, "_edges": F.when(~whole, F.col("_edges"))})


def _in_cells(points: DataFrame, sizes: list[int]) -> DataFrame:
    """Points repeated for their cells of all sides in use."""
    at = points.withColumn("_size", F.explode(F.array(*(F.lit(s).cast("long") for s in sizes)) if sizes else F.array().cast("array<long>")))
    return at.withColumns({"_ix": _index(F.col("x"), F.col("_size")), "_iy": _index(F.col("y"), F.col("_size"))})


def _met(at: DataFrame, spread: DataFrame, far: int, by: list[str]) -> DataFrame:
    both = at.join(spread, [*by, *_CELL]).drop(*_CELL)
    x, y = F.col("x"), F.col("y")
    boxed = x.between(F.col("x1"), F.col("x2")) & y.between(F.col("y1"), F.col("y2"))
    if far == 0:
        both = both.where(F.col("_whole") | (boxed & inside_edges(x, y, F.col("_edges")))).withColumn("d2", F.lit(0.0))
    else:
        both = both.where(F.col("_whole") | boxed).withColumn("d2", F.when(F.col("_whole"), F.lit(0.0)).otherwise(edges_distance2(x, y, F.col("_edges"))))
        both = both.where(F.col("d2") <= float(far) * far)
    return both.drop("x1", "y1", "x2", "y2", "_edges", "_whole")


def near_shapes(points: DataFrame, shapes: DataFrame, size: int, far: int = 0, by: list[str] | None = None) -> DataFrame:
    """Points (p_id, x, y) with the shapes (s_id, ring and more) at most ``far`` away: all columns and d2.

    Shapes narrower than ``size`` have the least cells. Columns ``by``, which both have, are to be equal.
    """
    boxes, sizes = _sized(shapes, size, far)
    return _met(_in_cells(points, sizes), _over_cells(boxes, far), far, by or [])


def smallest_around(points: DataFrame, shapes: DataFrame, size: int) -> DataFrame:
    """(p_id, s_id): of the shapes around a point the one of least area, then of least s_id.

    The least that holds all of a cell is around each point there, so that no greater one is compared with them.
    """
    boxes, sizes = _sized(shapes.withColumn("area", double_area(F.col("ring"))), size, 0)
    order = F.struct("area", "s_id")
    least = F.min(F.when(F.col("_whole"), order)).over(W.Window.partitionBy(*_CELL))
    spread = _over_cells(boxes, 0).withColumn("_least", least).where(F.col("_least").isNull() | (order <= F.col("_least"))).drop("_least")
    return _met(_in_cells(points, sizes), spread, 0, []).groupBy("p_id").agg(F.min(order).alias("m")).select("p_id", "m.s_id")


def ids_inside(points: DataFrame, shapes: DataFrame, size: int) -> DataFrame:
    """(s_id, ids): the points in each shape, as several arrays of p_id."""
    boxes, sizes = _sized(shapes, size, 0)
    at = _in_cells(points.select("p_id", "x", "y").where("p_id IS NOT NULL"), sizes)
    spread = _over_cells(boxes, 0)
    lists = at.groupBy(*_CELL).agg(F.collect_list("p_id").alias("ids")).join(spread.where("_whole").select("s_id", *_CELL), _CELL).select("s_id", "ids")
    return lists.unionByName(_met(at, spread.where("NOT _whole"), 0, []).groupBy("s_id").agg(F.collect_list("p_id").alias("ids")))


def _least(points: DataFrame, found: DataFrame, id_: str) -> DataFrame:
    """(p_id, id, d2) of each point from (x, y, id, d2): the least distance, then the least id."""
    best = found.groupBy("x", "y").agg(F.min(F.struct("d2", id_)).alias("m")).select(F.col("x").alias("_x"), F.col("y").alias("_y"), f"m.{id_}", "m.d2")
    return points.join(best, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select("p_id", id_, "d2")


def nearest_shape(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(p_id, s_id, d2): the nearest shape at any distance, 0 inside, then the one of least s_id.

    Points without a place have no row, nor has any point where there is no shape.
    """
    scratch = Scratch(points.sparkSession, "nearest")
    boxes = _boxed(shapes.select("s_id", "ring")).withColumns({"rx": F.col("ring")[0].x, "ry": F.col("ring")[0].y}).drop("ring")
    near = candidates(points, boxes, scratch).select("x", "y", "s_id", edges_distance2(F.col("x"), F.col("y"), F.col("_edges")).alias("d2"))
    return _least(points, near, "s_id")


def nearest_edge(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(p_id, e_id, d2): the nearest segment (e_id, ax, ay, bx, by) at any distance, then the one of least e_id."""
    scratch = Scratch(points.sparkSession, "nearest")
    ends = {"x1": F.least("ax", "bx"), "y1": F.least("ay", "by"), "x2": F.greatest("ax", "bx"), "y2": F.greatest("ay", "by"), "rx": F.col("ax"), "ry": F.col("ay")}
    d2 = segment_distance2(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    near = candidates(points, segments.select("e_id", "ax", "ay", "bx", "by").withColumns(ends), scratch).select("x", "y", "e_id", d2.alias("d2"))
    return _least(points, near, "e_id")


def crossings(ax: Column, ay: Column, bx: Column, by: Column, ring: Column) -> Column:
    """How many edges of a ring a segment crosses properly (corners and touches are none)."""
    turn = lambda px, py, qx, qy, rx, ry: F.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def hit(e: Column) -> Column:
        one = turn(ax, ay, bx, by, e.a.x, e.a.y) * turn(ax, ay, bx, by, e.b.x, e.b.y)
        two = turn(e.a.x, e.a.y, e.b.x, e.b.y, ax, ay) * turn(e.a.x, e.a.y, e.b.x, e.b.y, bx, by)
        return (one < 0) & (two < 0)

    return F.size(F.filter(edges(ring), hit))


def clip(lo: Column, hi: Column, from_: Column, to: Column) -> Column:
    """Length of an interval inside another, 0 if they do not meet."""
    return F.greatest(F.lit(0), F.least(hi, to) - F.greatest(lo, from_))
