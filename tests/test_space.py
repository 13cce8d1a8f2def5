"""Nearest, containing and assembled shapes against brute force."""

import math
import random

import pytest

from kvartal.operators import forest, grid, rings, shapes

FAR = 1 << 29


def _rhombus(x, y, a, b):
    return [(x - a, y), (x, y - b), (x + a, y), (x, y + b)]


def _inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        side = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (side > 0) == (by > ay):
            odd = not odd
    return odd


def _segment2(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    along, whole = (x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy
    if along <= 0:
        return float((x - ax) ** 2 + (y - ay) ** 2)
    if along >= whole:
        return float((x - bx) ** 2 + (y - by) ** 2)
    side = float(dx * (y - ay) - (x - ax) * dy)
    return side * side / whole


def _ring2(x, y, ring):
    return 0.0 if _inside(x, y, ring) else min(_segment2(x, y, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1]))


def _places(r, n):
    """Points near, in one dense place, in one place many times, and as far as coordinates go."""
    out = [(r.randrange(-5000, 5000), r.randrange(-5000, 5000)) for _ in range(n)]
    out += [(700 + r.randrange(30), 700 + r.randrange(30)) for _ in range(n // 2)] + [(123, 456)] * 20
    return out + [(FAR, FAR), (-FAR, FAR), (FAR, -3), (-1, -1), (0, 0), (-1, 0)]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, *p) for i, p in enumerate(_places(random.Random(1), 120))]
    return rows, spark.createDataFrame(rows, "p_id long, x long, y long")


def test_nearest_point_at_any_distance(spark, points):
    r = random.Random(2)
    things = [(i, *p) for i, p in enumerate(_places(r, 150)[:-4])] + [(900 + i, 701, 701) for i in range(40)]
    rows = points[0]
    got = grid.nearest_any(points[1].toDF("a_id", "ax", "ay"), spark.createDataFrame(things, "b_id long, bx long, by long")).collect()
    want = {(p, *min(((x - bx) ** 2 + (y - by) ** 2, b) for b, bx, by in things)) for p, x, y in rows}
    assert {(g.a_id, g.d2, g.b_id) for g in got} == want and len(got) == len(rows)


def test_one_thing_for_all(spark, points):
    one = spark.createDataFrame([(5, FAR, -FAR)], "b_id long, bx long, by long")
    assert {g.b_id for g in grid.nearest_any(points[1].toDF("a_id", "ax", "ay"), one).collect()} == {5}
    assert grid.nearest_any(points[1].toDF("a_id", "ax", "ay"), one.limit(0)).count() == 0
    assert grid.nearest_any(points[1].toDF("a_id", "ax", "ay").limit(0), one).count() == 0
    nowhere = spark.createDataFrame([(1, None, 3), (2, 4, 4)], "a_id long, ax long, ay long")
    assert [g.a_id for g in grid.nearest_any(nowhere, one).collect()] == [2]


def test_nearest_shapes_and_edges(spark, points):
    r = random.Random(3)
    sites = [(i, _rhombus(r.randrange(-6000, 6000), r.randrange(-6000, 6000), r.choice([3, 40, 900]), r.choice([2, 60, 700]))) for i in range(60)]
    sites += [(100, _rhombus(-200_000, 3, 150_000, 90_000)), (101, sites[5][1]), (102, [(-3000, -3000), (3000, -3000), (3000, 3000), (0, -2900), (-3000, 3000)])]
    df = spark.createDataFrame(sites, "s_id long, ring array<struct<x:long,y:long>>")
    got = {(g.p_id, g.d2, g.s_id) for g in shapes.nearest_shape(points[1], df).collect()}
    assert got == {(p, *min((_ring2(x, y, ring), s) for s, ring in sites)) for p, x, y in points[0]}
    edges = [(s, *ring[0], *ring[1]) for s, ring in sites]
    got = {(g.p_id, g.d2, g.e_id) for g in shapes.nearest_edge(points[1], spark.createDataFrame(edges, "e_id long, ax long, ay long, bx long, by long")).collect()}
    assert got == {(p, *min((_segment2(x, y, *e), s) for s, *e in edges)) for p, x, y in points[0]}


@pytest.mark.parametrize("far", [0, 35])
def test_near_shapes_of_all_sizes(spark, points, far):
    r = random.Random(4)
    sites = [(i, i % 2, _rhombus(r.randrange(-6000, 6000), r.randrange(-6000, 6000), 3**k, 1 + 2 * 3**k)) for i, k in enumerate([0, 3, 5, 8, 13] * 12)]
    df = spark.createDataFrame(sites, "s_id long, kind long, ring array<struct<x:long,y:long>>")
    got = sorted((g.p_id, g.s_id, g.d2) for g in shapes.near_shapes(points[1], df, 50, far).collect())
    assert got == sorted((p, s, d2) for p, x, y in points[0] for s, _, ring in sites if (d2 := _ring2(x, y, ring)) <= far * far)
    same = sorted((g.p_id, g.s_id) for g in shapes.near_shapes(points[1].selectExpr("*", "p_id % 2 AS kind"), df, 50, far, by=["kind"]).collect())
    assert same == [(p, s) for p, s, _ in got if p % 2 == s % 2]
    assert shapes.near_shapes(points[1], df.limit(0), 50, far).count() == 0


def test_a_huge_shape_is_a_few_rows(spark, points):
    df = spark.createDataFrame([(1, _rhombus(0, 0, 1 << 28, 1 << 28))], "s_id long, ring array<struct<x:long,y:long>>")
    plan = shapes.near_shapes(points[1], df, 1)
    assert plan.count() == sum(abs(x) + abs(y) <= 1 << 28 for _, x, y in points[0])


def test_forest(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        x, y, a = r.randrange(3000), r.randrange(3000), r.choice([0, 5, 60, 300, 900, 2500])
        rows.append((i, i % 2, x, y, _rhombus(x, y, a, a) if a else None, r.choice(["", None, f"n{i}"])))
    rows += [(200, 0, 50, 50, _rhombus(50, 50, 4000, 4000), None), (201, 0, 60, 60, _rhombus(60, 60, 4000, 4000), "twin"), (202, 5, 1, 1, None, "alone"), (203, 0, None, None, None, "nowhere"), (204, None, 1, 1, None, "no kind")]
    df = spark.createDataFrame(rows, "id long, kind long, x long, y long, ring array<struct<x:long,y:long>>, name string")
    area = {i: 2 * (ring[2][0] - x) ** 2 if ring else 0 for i, _, x, y, ring, _ in rows}
    parent = {}
    for i, kind, x, y, ring, _ in rows:
        around = [(area[j], j) for j, k2, _, _, r2, _ in rows if r2 and kind is not None and k2 == kind and x is not None and _inside(x, y, r2) and (area[j] > area[i] or (ring and area[j] == area[i] and j > i))]
        if around:
            parent[i] = max(around)[1]

    def top(i):
        while i in parent:
            i = parent[i]
        return i

    found = forest.contain(df)
    assert {(g.id, g.root) for g in found.collect()} == {(i, top(i)) for i, *_ in rows}
    names = {i: n for i, *_, n in rows}
    for g in forest.merged(df, found).collect():
        own = sorted(i for i, *_ in rows if top(i) == g.id)
        assert g.ids == own and g.name == (names[g.id] or next((names[i] for i in own if names[i]), ""))


def _ways(order, relation=1, first=0):
    """A ring through nodes in order, its ways turned at random."""
    r = random.Random(len(order))
    ways = list(range(first, first + len(order)))
    r.shuffle(ways)
    return [(relation, w, *((a, b) if r.random() < 0.5 else (b, a)), "outer") for w, (a, b) in zip(ways, zip(order, order[1:] + order[:1]))]


SCHEMA = "relation long, way long, a long, b long, role string"


def _walk(members):
    """{(relation, ring): [(way, forward)]} by following ends."""
    out = {}
    for rel in {m[0] for m in members}:
        ways = {w: (a, b) for r2, w, a, b, _ in members if r2 == rel}
        ends = {}
        for w, (a, b) in ways.items():
            ends.setdefault(a, []).append(w)
            ends.setdefault(b, []).append(w)
        if None in ends or any(len(x) != 2 for x in ends.values()):
            continue
        left = set(ways)
        while left:
            first = min(left)
            at, way, chain = ways[first][1], first, [(first, True)]
            left.remove(first)
            while at != ways[first][0]:
                way = next(w for w in ends[at] if w != way)
                forward = ways[way][0] == at
                at = ways[way][1] if forward else ways[way][0]
                chain.append((way, forward))
                left.remove(way)
            out[rel, first] = chain
    return out


def test_rings(spark):
    members = _ways(list(range(9))) + _ways([20, 21], 1, 50) + _ways([30], 1, 60) + _ways(list(range(5)), 2, 100)[:-1] + _ways([1, 2, 3], 3, 200) + [(3, 210, 1, 9, "outer")] + _ways([1, 2, 3, 4], 4, 300) + [(5, 400, None, None, "outer"), (6, 500, 1, None, "")]
    members += members[:2]
    got = {}
    for g in sorted(rings.assemble(spark.createDataFrame(members, SCHEMA)).collect(), key=lambda g: g.no):
        got.setdefault((g.relation, g.ring), []).append((g.way, g.forward))
    assert got == _walk(list(dict.fromkeys(members))) and {r for r, _ in got} == {1, 4}
    assert rings.assemble(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = rings.replaced(spark.createDataFrame(members + [(4, 999, 7, 7, "inner")], SCHEMA), spark.createDataFrame([(1,), (4,)], "relation long"))
    assert {g.way for g in gone.collect()} == {m[1] for m in members if m[0] in (1, 4)}


def test_a_long_ring_takes_a_logarithm_of_rounds(spark, monkeypatch):
    n, saves = 100_000, []
    df = spark.range(n).selectExpr("1L AS relation", "id * 7919 % 100003 AS way", "id AS a", f"(id + 1) % {n} AS b", "'outer' AS role")
    save = rings.Scratch.save
    monkeypatch.setattr(rings.Scratch, "save", lambda self, d, name: saves.append(name) or save(self, d, name))
    out = rings.assemble(df)
    assert out.count() == n and out.selectExpr("min(no)", "max(no)", "count(DISTINCT no)").first()[:] == (0, n - 1, n)
    assert out.where("forward AND (way * 1) >= 0").count() == n and len(saves) < math.log2(n) + 6


def test_cells_off_the_edges_are_not_compared(spark):
    """Rings of 3 to 9 corners over dense points: results as by brute force, and most pairs met by whole cells."""
    r = random.Random(8)
    places = [(i, r.randrange(-2000, 2000), r.randrange(-2000, 2000)) for i in range(1500)]
    at = spark.createDataFrame(places, "p_id long, x long, y long")
    rings = []
    for i in range(24):
        x, y, a = r.randrange(-1500, 1500), r.randrange(-1500, 1500), r.choice([30, 400, 1900])
        angles = sorted(r.random() * 2 * math.pi for _ in range(3 + i % 7))
        rings.append((i, [(round(x + a * math.cos(t)), round(y + a * math.sin(t) * r.random())) for t in angles]))
    df = spark.createDataFrame(rings, "s_id long, ring array<struct<x:long,y:long>>")
    want = {(p, s) for p, x, y in places for s, ring in rings if _ring2(x, y, ring) == 0}
    assert sorted((g.p_id, g.s_id) for g in shapes.near_shapes(at, df, 50).collect()) == sorted(want)
    assert sorted((p, g.s_id) for g in shapes.ids_inside(at, df, 50).collect() for p in g.ids) == sorted(want)
    area = {s: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) for s, ring in rings}
    least = {p: min((area[s], s) for q, s in want if q == p)[1] for p in {p for p, _ in want}}
    assert {g.p_id: g.s_id for g in shapes.smallest_around(at, df, 50).collect()} == least
    boxes, sizes = shapes._sized(df, 50, 0)
    met = shapes._in_cells(at, sizes).join(shapes._over_cells(boxes, 0), ["_size", "_ix", "_iy"])
    whole = met.where("_whole").count()
    assert whole > len(want) / 3 and met.count() < 3 * len(want)


@pytest.mark.parametrize("n", [40, 6000])
def test_the_nearest_few_of_many_in_one_place(spark, monkeypatch, n):
    """Objects that share places, and dense ones beside a lonely one: pairs that are looked at grow with the places."""
    r = random.Random(9)
    things = [(i, r.randrange(0, 40) * 10 if i % 9 else 5000, r.randrange(0, 20) * 10) for i in range(n)]
    asked = [(i, r.choice([0, 55, 200, 390, 4100, 9000]), r.choice([0, 95, 170])) for i in range(60)]
    met = []
    within = grid.within
    monkeypatch.setattr(grid, "within", lambda a, b, radius: met.append(within(a, b, radius)) or met[-1])
    got = grid.nearest(spark.createDataFrame(asked, "a_id long, ax long, ay long"), spark.createDataFrame(things, "b_id long, bx long, by long"), 1000, 3).collect()
    want = [(a, k + 1, b, d2) for a, x, y in asked for k, (d2, b) in enumerate(sorted(((x - bx) ** 2 + (y - by) ** 2, b) for b, bx, by in things if (x - bx) ** 2 + (y - by) ** 2 <= 1_000_000)[:3])]
    assert sorted(tuple(g) for g in got) == sorted(want)
    assert n < 1000 or len(met) > 1 and sum(m.count() for m in met) < 60 * n / 20
