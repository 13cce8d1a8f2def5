import re
from collections import defaultdict

import numpy as np
import pytest

from kvartal.llm import mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == [96, 3, 3]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    t = mixing.targets([100, 50, 1, 0, 7], [1, 2, 3, 1, 2])
    assert sum(t) == pytest.approx(158) and all(x <= 3 * s for x, s in zip(t, [100, 50, 1, 0, 7]))


def test_splitting_tree_keeps_quotas():
    q = [1000, 17, 0, 300]
    leaves = mixing.split_quotas(q, 16, 3)
    assert np.array(leaves).sum(axis=0).tolist() == q and leaves == mixing.split_quotas(q, 16, 3)
    assert max(map(sum, leaves)) - min(map(sum, leaves)) <= 4
    assert np.array([mixing.split_quotas([400, 400], 2, s)[0][0] for s in range(300)]).mean() == pytest.approx(200, abs=4)


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for r in rows:
        by[r[2]] += size(r[1])
    order = sorted(by, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([by[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    took = defaultdict(int)
    assert sorted((repr(g.doc_id), g["size"]) for g in got) == sorted((repr(r[0]), size(r[1])) for r in rows)
    for g in got:
        assert g.source_size == by[g.source] and g.target == pytest.approx(goal[g.source])
        assert 0 <= g.taken <= 3 * g["size"] and g.taken == g["size"] * len(g.shards) and all(0 <= s < mixing.SHARDS for s in g.shards)
        took[g.source] += g.taken
    near(rows, {s: (took[s], goal[s]) for s in by}, size)
    return {s: (took[s], goal[s]) for s in by}


def near(rows, got, size):
    """Every source comes within half a document of its target, or of all that may be taken."""
    for s, (took, goal) in got.items():
        sizes = [n for r in rows if r[2] == s and (n := size(r[1]))]
        assert abs(took - goal) <= max(sizes, default=0) / 2 + 1, (s, took, goal)


def test_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 5}" if i % 3 else "hot", 1) for i in range(4000)]
    rows += [(5000, None, "s1", 1), (5001, "", None, 1), (5002, "a\tb\x0bc d", None, 1), (None, "x y", "s2", 1), (5003, "one two", "Z", 1), (5003, "one two", "Z", 1), (5004, "w " * 20000, "s3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs).collect()
    for s, (took, goal) in check(rows, got).items():
        assert abs(took - goal) <= 2, s
    again = mixing.mix(docs.repartition(13)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    whole = mixing.mixture(docs)
    assert whole.count() == sum(len(g.shards) for g in got) and "text" in whole.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_edge_is_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 4)
    rows = [(i, "w " * (1 + i % 9), "b" if i % 7 else "a", 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, n int")).collect()
    assert all(abs(took - goal) <= 9 for took, goal in check(rows, got).values())


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "w " * 10, "a", k) for k in range(300)] + [(2, "w " * 10, "b", k) for k in range(400)] + [(3, "w w", None, 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    for n in (1, 5):
        got = mixing.mix(docs.repartition(n)).collect()
        took = check(rows, got)
        assert all(abs(a - b) <= 5 for a, b in took.values())
        whole = mixing.mix(docs.repartition(n), whole_rows=True).collect()
        assert sorted((r.doc_id, r.taken) for r in whole) == sorted((r.doc_id, r.taken) for r in got) and len({(r.doc_id, r.k) for r in whole}) == 701


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2], 1) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, seed: [[0] * len(quotas)] * shards)
    assert all(r.taken == 0 and r.shards == [] for r in mixing.mix(docs).collect())


def test_names_of_any_kind(spark):
    schema = "doc_id long, text string, source string, size string, times int, k int, s int, u int, cut int, bounds int, pick int, rank int, by int, rid int, t int, n int"
    docs = spark.createDataFrame([(i % 4, "a b c", "xy"[i % 2], "mine", *range(12)) for i in range(9)], schema)
    names = ("size_", "source_size", "target", "taken", "shards")
    got = mixing.mix(docs, whole_rows=True, names=names).collect()
    assert len(got) == 9 and all(r["size"] == "mine" and r.size_ == 3 and (r.times, r.rank, r.n) == (0, 7, 11) for r in got)
    whole = mixing.draw(mixing.mix(docs, whole_rows=True, names=names)).collect()
    assert len(whole) == sum(len(r.shards) for r in got) > 0


def test_query(spark, sf_dir):
    from kvartal.llm.queries import queries

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries()["op3_mix"](spark, sf_dir).collect()
    check(rows, got)
    assert {s for r in got for s in r.shards} <= set(range(mixing.SHARDS))


def test_literal(spark):
    """Names with quotes, control characters and none come back as they are; no Python worker makes the rows."""
    names = ['a"b', "c\\d", "e\n\t\x01f", "é\U0001f600", "", None]
    rows = [{"s": n, "p": {"x": 2**62 - i, "y": 1 / 3 + i, "z": [i] * i}} for i, n in enumerate(names)]
    made = mixing._literal(spark, rows, "s:string,p:struct<x:bigint,y:double,z:array<bigint>>")
    assert [(r.s, r.p.x, r.p.y, r.p.z) for r in made.collect()] == [(r["s"], *r["p"].values()) for r in rows]
    assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    assert mixing._literal(spark, [], "s:string").count() == 0
