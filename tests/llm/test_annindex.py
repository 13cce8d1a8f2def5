import math

import numpy as np
import pytest

from kvartal.llm import annindex
from kvartal.llm.queries import queries

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    """query id -> [(distance, id)] of all candidates, nearest first."""
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            near = [(float(np.sqrt(((x - y) ** 2).sum())), math.inf if i is None else i) for b, (i, y) in enumerate(good) if b != a and len(x) == len(y)]
            out.append((q, sorted(near)[:k]))
    return out


def same(got, want):
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, []).append((r["rank"], math.inf if r.vec_id is None else r.vec_id, r.score))
    assert sorted(lists) == sorted({q for q, near in want if near})
    for q, near in want:
        mine = sorted(lists.get(q, []))
        assert [(r, i) for r, i, _ in mine] == [(r, i) for r, (_, i) in enumerate(near, 1)]
        assert np.allclose([s for *_, s in mine], [d for d, _ in near], rtol=1e-12)


def rows_with(n, seed, d=16):
    rng = np.random.default_rng(seed)
    x = np.float32(rng.normal(size=(n, d)) + rng.integers(0, 4, size=(n, 1)) * 3)
    return [(int(i), [float(c) for c in r], int(i % 3)) for i, r in zip(rng.permutation(n), x)]


def test_small_tables_are_exact(spark):
    rows = rows_with(60, 1)
    rows += [(1000 + i, rows[5][1], 0) for i in range(30)] + [(2000, rows[5][1], 0), (None, rows[5][1], 0), (None, rows[8][1], None)]
    rows += [(3000, None, 1), (3100, [], 1), (3200, [0.0] * 16, 1), (3300, [NAN] * 16, 1), (3400, [INF] + [1.0] * 15, 1), (3500, [None] + [1.0] * 15, 1)]
    rows += [(4000, [1.0, 2.0], 0), (4001, [1.0, 2.5], 0), (4100, [7.0], 0), (-200, rows[9][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(annindex.nearest(df).collect(), brute(rows))
    clash = df.selectExpr("*", "1 AS score", "2 AS rank", "3 AS query_id", "4 AS rid", "5 AS d")
    same(annindex.nearest(clash).collect(), brute(rows))
    assert annindex.nearest(df.limit(0)).count() == 0


def test_copies_and_few_files(spark, monkeypatch):
    # files are many parts, and queries that read one file only find too little there
    monkeypatch.setattr(annindex, "PART", 40)
    monkeypatch.setattr(annindex, "BATCH", 3)
    rows = rows_with(300, 2, 8)
    rows += [(1000 + i, rows[0][1], 0) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = annindex.nearest(df, every=20, n_posted=1, n_read=1).collect()
    want = brute(rows, every=20)
    assert {q: sum(r.query_id == q for r in got) for q, _ in want} == {q: 10 for q, _ in want}
    same(annindex.nearest(df, every=20, n_posted=128, n_read=128, share=1.0).collect(), want)


def test_repeated_rows_find_each_other(spark):
    rows = [(100, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (5, [0.0, 1.0], 0)]
    got = sorted(tuple(r) for r in annindex.nearest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(100, 1, 100, 0.0)] * 2 + [(100, 2, 5, math.sqrt(2))] * 2


def test_footrule():
    rng = np.random.default_rng(4)
    for _ in range(50):
        q, o = rng.permutation(12)[:5], rng.permutation(12)[:5]
        place = np.full(12, 5)
        place[q] = np.arange(5)
        at = lambda x, p: int(np.flatnonzero(x == p)[0]) if p in x else 5
        assert annindex.footrule(place, o[None])[0] == sum(abs(at(q, p) - at(o, p)) for p in range(12))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    found = {}
    for r in queries()["op11_ann"](spark, path).collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows)
    assert all(sorted(found[q]) == found[q] or len(found[q]) == 10 for q, _ in want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in near}) for q, near in want)
    assert hits >= 0.95 * sum(len(near) for _, near in want)
