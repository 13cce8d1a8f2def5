import os

import random

import pytest
from pyspark.sql import functions as F

from kvartal.functions import geometry, rng, rounding, text
from kvartal.operators import alloc, assign, events, graph, seq
from kvartal.operators.quantiles import quantiles
from kvartal.streaming import clock


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_rounding(spark):
    v = lambda f, x: one(spark, f(F.lit(x)))
    assert [v(rounding.half_even, x) for x in (2.5, 3.5, -2.5)] == [2, 4, -2]
    assert [v(rounding.half_away, x) for x in (2.5, -2.5, 0.4)] == [3, -3, 0]
    assert [v(rounding.half_up, x) for x in (2.5, -2.5)] == [3, -2]
    assert one(spark, rounding.ratio(F.lit(7).cast("long"), F.lit(2).cast("long"))) == 4


def test_philox_columns_match_integers(spark):
    key = rng.stream_key(5, rng.PLACES)
    df = rng.philox(spark.range(50), key, [F.col("id"), F.lit(2**32 - 1), F.col("id") * 7, F.lit(3)], list("abcd"))
    assert {r.id: tuple(r)[1:] for r in df.where("a >= 0").collect()} == {i: rng.philox_ints(key, (i, 2**32 - 1, i * 7, 3)) for i in range(50)}


def test_prefix_sum_over_buckets(spark):
    df = spark.range(1, 500).select((F.col("id") * 3).alias("o"), (F.col("id") % 5).alias("v"))
    got = {r.o: r.p for r in seq.prefix_sum(df, "v", "o", "p", width=16).collect()}
    total = 0
    for i in range(1, 500):
        assert got[i * 3] == total
        total += i % 5


def test_boarding_matches_a_loop(spark):
    rng_ = random.Random(4)
    arrivals = [(s, rng_.randrange(1000), i) for i in range(400) for s in [rng_.randrange(3)]]
    vehicles = [(s, k, 50 + 97 * k, rng_.randrange(0, 15)) for s in range(3) for k in range(10)]
    got = {r.id: r.k for r in events.boarding(spark.createDataFrame(arrivals, "stop long, t long, id long"), spark.createDataFrame(vehicles, "stop long, k long, depart long, seats long"), "stop").collect()}
    for s in range(3):
        queue = sorted((t, i) for x, t, i in arrivals if x == s)
        for _, k, d, n in sorted(v for v in vehicles if v[0] == s):
            on = [q for q in queue if q[0] <= d][:n]
            assert all(got[i] == k for _, i in on)
            queue = [q for q in queue if q not in on]
        assert all(got[i] is None for _, i in queue)


def test_gravity_keeps_capacities(spark):
    people = spark.range(300).select(F.col("id").alias("person"), (F.col("id") % 3).alias("block"))
    places = spark.range(12).select(F.col("id").alias("place"), (5 + F.col("id") * 4).alias("seats"))
    pull = places.join(spark.range(3).select(F.col("id").alias("block"))).select("block", "place", (1 + F.col("place")).alias("w"))
    got = assign.gravity(people, places, pull, 1, rounds=12).collect()
    assert len({r.person for r in got}) == len(got) == 300
    for p in range(12):
        assert sum(r.place == p for r in got) <= 5 + 4 * p
    again = assign.gravity(people.repartition(3), places, pull.repartition(5), 1, rounds=12).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_gravity_leaves_no_one_while_seats_are_in_reach(spark):
    # one place after another is asked by all, as its weight is far above the next one's
    people = spark.range(42).select(F.col("id").alias("person"), F.when(F.col("id") < 40, 0).otherwise(1).cast("long").alias("block"))
    places = spark.range(10).select(F.col("id").alias("place"), F.lit(4).alias("seats"))
    pull = places.select(F.lit(0).cast("long").alias("block"), "place", F.expr("cast(pow(8, place) as long)").alias("w"))
    got = assign.gravity(people, places, pull, 1).collect()
    assert len(got) == 42 and {(r.person, r.place, r["round"]) for r in got if r.person >= 40} == {(40, None, None), (41, None, None)}
    assert all(sum(r.place == p for r in got) == 4 for p in range(10)) and max(r["round"] or 0 for r in got) >= 6


def test_largest_remainder_in_groups(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 4, 7), ("b", 5, 3)], "g string, id long, w long")
    got = {r.id: r.share for r in alloc.largest_remainder(df, 10, "w", "id", ["g"]).collect()}
    assert got == {1: 4, 2: 3, 3: 3, 4: 7, 5: 3}


def test_components_of_chains(spark):
    n = spark.range(200)
    e = n.where("id % 50 <> 49").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.id: r.component for r in graph.weak_components(n, e).collect()} == {i: i // 50 * 50 for i in range(200)}


def test_projection(spark):
    e, n = geometry.project(F.lit(37.6173), F.lit(55.7558))
    assert one(spark, e) == pytest.approx(413_230, abs=60) and one(spark, n) == pytest.approx(6_179_900, abs=400)
    e, n = geometry.project(F.lit(39.0), F.lit(0.0))
    assert one(spark, e) == pytest.approx(500_000, abs=1e-6) and one(spark, n) == pytest.approx(0, abs=1e-6)


def test_text(spark):
    assert [one(spark, text.metres(F.lit(x))) for x in ("12", "3.5 m", "6'", "tall")] == [12.0, 3.5, pytest.approx(1.8288), None]
    assert [one(spark, text.object_type(F.lit(x))) for x in ("n1", "w22", "r3", "x4")] == [0, 1, 2, None]
    assert [one(spark, text.number(F.lit(x), 3)) for x in (1234.5, -0.0001, 2.0)] == ["1234.5", "0", "2"]
    assert one(spark, text.squeeze(F.lit("  a \n b  c "), 4)) == "a b…"


@pytest.mark.parametrize("per_batch", [1, 2, 100])
def test_wait_limit_stream_does_not_depend_on_batches(spark, tmp_path, per_batch):
    rows = [(s, t, 0, s * 100 + t, 0) for s in range(2) for t in range(20)] + [(s, t, 1, 0, 3) for s in range(2) for t in (5, 11, 40)]
    rows += [(3, 2, 0, 900, 0), (3, 7, 0, 901, 0), (3, 30, 0, 902, 0), (4, 95, 0, 903, 0), (4, 99, 1, 0, 1)]  # nobody comes for those at stop 3
    schema = "key long, t long, kind long, id long, seats long"
    for i in range(4):
        at = tmp_path / f"part{i}"
        spark.createDataFrame([r for r in rows if 25 * i <= r[1] < 25 * i + 25] or [(9, 25 * i, 0, 0, 0)], schema).coalesce(1).write.parquet(str(at))
        for f in at.glob("*.parquet"):
            f.rename(tmp_path / f"f{i}.parquet")
            os.utime(tmp_path / f"f{i}.parquet", (1_000_000 + i * 100,) * 2)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{tmp_path}/f*.parquet").where("key < 9")
    got = sorted(map(tuple, clock.drain(clock.wait_limit(s, 15), f"wait{per_batch}").collect()))
    queue, want = {}, []
    for key, t, kind, i, seats in sorted(rows, key=lambda r: r[1:4]):
        q = queue.setdefault(key, [])
        while q and q[0][0] + 15 < t:
            a, j = q.pop(0)
            want.append((key, j, a + 15, "gave up"))
        if kind == 0:
            q.append((t, i))
        else:
            want += [(key, j, t, "boarded") for _, j in q[:seats]]
            del q[:seats]
    want += [(key, i, t + 15, "gave up") for key, q in queue.items() for t, i in q if t + 15 <= 99]
    assert got == sorted(want) and {r[1] for r in got} == {r[3] for r in rows if r[2] == 0}


def test_largest_remainder_against_one_ranking(spark):
    from fractions import Fraction

    rows = [("ab"[i % 2], i, (i * 7919) % 101 + (i % 5 == 0)) for i in range(500)]
    for by in (["g"], None):
        got = {r.id: r.share for r in alloc.largest_remainder(spark.createDataFrame(rows, "g string, id long, w long"), 1003, "w", "id", by).collect()}
        for g in ("a", "b") if by else (None,):
            own = [r for r in rows if g in (None, r[0])]
            total = sum(r[2] for r in own)
            exact = {r[1]: Fraction(1003 * r[2], total) for r in own}
            base = {i: int(x) for i, x in exact.items()}
            for i in sorted(exact, key=lambda i: (base[i] - exact[i], i))[: 1003 - sum(base.values())]:
                base[i] += 1
            assert {i: got[i] for i in base} == base


def _mutual(n, arcs):
    """Least node that each reaches and is reached by, by walking from every node."""
    out = {i: {b for a, b in arcs if a == i} for i in range(n)}
    reach = {}
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        reach[i] = seen
    return {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}


@pytest.mark.parametrize("n, m, seed", [(40, 45, 1), (40, 90, 2), (12, 0, 3)])
def test_strong_components_match_walks(spark, n, m, seed):
    r = random.Random(seed)
    arcs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(3, 3)]
    edges = spark.createDataFrame(arcs + arcs[:3], "a long, b long")
    got = {x.id: x.component for x in graph.strong_components(spark.range(n), edges).collect()}
    assert got == _mutual(n, arcs)


def test_strong_components_of_a_long_way(spark):
    ring = [(i, (i + 1) % 60) for i in range(60)]
    way = [(i, i + 1) for i in range(60, 120)]
    edges = spark.createDataFrame([*ring, (7, 60), *way], "a long, b long")
    got = {x.id: x.component for x in graph.strong_components(spark.range(121), edges).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(121)}


def test_quantiles_match_sorted_values(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *map(float, range(30))])) for _ in range(700)] + [("one", 5.0), ("none", None)]
    at = {"low": 0.0, "half": 0.5, "most": 0.97, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: tuple(x)[1:] for x in quantiles(df, ["g"], "v", at).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(v for h, v in rows if h == g and v is not None)
        p = [q * (len(v) - 1) for q in at.values()]
        want[g] = tuple(v[int(x)] + (v[min(int(x) + 1, len(v) - 1)] - v[int(x)]) * (x - int(x)) for x in p)
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g])
    assert quantiles(df.where("false"), ["g"], "v", at).collect() == []
