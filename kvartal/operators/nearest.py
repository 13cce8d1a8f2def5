"""The nearest object at any distance: branch and bound over cells of several levels.

Points and objects lie in cells whose side doubles from level to level. The search starts
with the few cells that hold everything and goes down, all points at once. A pair of cells
has a lower bound, the gap between their contents' boxes, and an upper bound, the farthest
that a point can be from a known point of an object there. A cell of objects is left as soon
as its lower bound exceeds another's upper bound, so what goes down is a few cells for each cell
of points, near or far. Objects of like size share a tree: a huge one does not widen the
boxes of small ones. It ends where the cells left hold ``FEW`` objects at most, so a dense
place goes deeper than an empty one would need, and no radius is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.scratch import Scratch

#: Levels that a round goes down, and objects in a cell that need no further round.
STEP, FEW = 3, 8
_SLACK = 1 + 1e-9


def bits(x: Column) -> Column:
    """Binary digits of a whole number from 0 on; 0 has none."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def _up(x: str, level: int) -> Column:
    return F.shiftright(F.col(x), level)


def _cells(points: DataFrame, level: int) -> DataFrame:
    cells = points.groupBy(_up("x", level).alias("px"), _up("y", level).alias("py"))
    return cells.agg(*(f(c).cast("double").alias(f"p{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))


def _nodes(objects: DataFrame, level: int) -> DataFrame:
    """Cells of the objects' known points: boxes of these and of the whole objects, and how many."""
    nodes = objects.groupBy("tree", _up("rx", level).alias("sx"), _up("ry", level).alias("sy"))
    known = [f(f"r{c}").cast("double").alias(f"r{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    whole = [f(F.col(f"{c}{i}")).cast("double").alias(f"s{n}{c}") for c in "xy" for i, n, f in ((1, "lo", F.min), (2, "hi", F.max))]
    return nodes.agg(F.count("*").alias("n"), *known, *whole)


def _gap(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(other_lo) - F.col(hi), F.col(lo) - F.col(other_hi))


def _bounds() -> tuple[Column, Column]:
    lower = sum((_gap(f"plo{c}", f"phi{c}", f"slo{c}", f"shi{c}") * _gap(f"plo{c}", f"phi{c}", f"slo{c}", f"shi{c}") for c in "xy"), F.lit(0.0))
    far = lambda c: F.greatest(F.abs(F.col(f"rhi{c}") - F.col(f"plo{c}")), F.abs(F.col(f"phi{c}") - F.col(f"rlo{c}")))
    return lower, sum((far(c) * far(c) for c in "xy"), F.lit(0.0))


def _left(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Pairs whose lower bound does not exceed the least upper bound of their points."""
    lower, upper = _bounds()
    best = F.min("upper").over(W.Window.partitionBy(*key))
    return pairs.withColumns({"lower": lower, "upper": upper}).withColumn("best", best).where(F.col("lower") <= F.col("best") * _SLACK)


def candidates(points: DataFrame, objects: DataFrame, scratch: Scratch) -> DataFrame:
    """Each different place (x, y) of ``points`` with all ``objects`` that can be its nearest, ties included.

    Objects have a box (x1, y1, x2, y2), a point of theirs (rx, ry) and any other columns,
    all coordinates whole numbers below 2**31. Nulls in coordinates take no part.
    """
    at = scratch.save(points.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL").distinct(), "points")
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    whole = objects.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x1", "y1", "x2", "y2", "rx", "ry")))
    things = scratch.save(whole.withColumns({"tree": F.floor(bits(side) / 2).cast("int"), "o_id": F.monotonically_increasing_id()}), "objects")

    reach = lambda *cs: F.greatest(*(F.max(F.abs(F.col(c))) for c in cs))
    spans = [r[0] or 0 for r in (at.agg(reach("x", "y")).first(), things.agg(reach("rx", "ry")).first())]
    level = max(0, max(spans).bit_length() - STEP)
    pairs = None
    while True:
        p, s = _cells(at, level), _nodes(things, level)
        if pairs is None:  # a few hundred cells, and as many of each size
            met = p.withColumn("k", F.lit(0)).join(s.withColumn("k", F.lit(0)), "k")
        else:
            up = pairs.select(*(F.col(c).alias(f"_{c}") for c in ("px", "py", "tree", "sx", "sy")))
            down = before - level
            met = up.join(p, (_up("px", down) == F.col("_px")) & (_up("py", down) == F.col("_py")))
            met = met.join(s, (F.col("tree") == F.col("_tree")) & (_up("sx", down) == F.col("_sx")) & (_up("sy", down) == F.col("_sy")))
        kept = scratch.save(_left(met, ["px", "py"]).select("px", "py", "tree", "sx", "sy", "n"), "pairs")
        if pairs is not None:
            scratch.drop(pairs)
        pairs, before = kept, level
        if level == 0 or (pairs.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
        level = max(0, level - STEP)

    # the objects of the cells left, against cells of points, then against points
    own = things.withColumns({"_sx": _up("rx", level), "_sy": _up("ry", level)})
    boxes = {f"s{n}{c}": F.col(f"{c}{i}").cast("double") for c in "xy" for i, n in ((1, "lo"), (2, "hi"))} | {f"r{n}{c}": F.col(f"r{c}").cast("double") for c in "xy" for n in ("lo", "hi")}
    keys = pairs.select("px", "py", F.col("tree").alias("_tree"), F.col("sx").alias("_x"), F.col("sy").alias("_y"))
    met = keys.join(own.select("o_id", "tree", "_sx", "_sy", *(v.alias(k) for k, v in boxes.items())), (F.col("_tree") == F.col("tree")) & (F.col("_x") == F.col("_sx")) & (F.col("_y") == F.col("_sy")))
    few = _left(met.join(_cells(at, level), ["px", "py"]), ["px", "py"]).select("px", "py", "o_id", *boxes)
    placed = at.select("x", "y", _up("x", level).alias("px"), _up("y", level).alias("py"), *(F.col(c).cast("double").alias(f"p{n}{c}") for c in "xy" for n in ("lo", "hi")))
    last = _left(placed.join(few, ["px", "py"]), ["x", "y"]).select("x", "y", "o_id")
    return last.join(things.drop("tree"), "o_id").drop("o_id")
