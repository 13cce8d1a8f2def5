import math

import numpy as np
import pytest
from oracle import rows_of, spark_rows

from kvartal.llm import negatives
from kvartal.llm.queries import oracle_sql, queries

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def brute(rows, every=50):
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for a, (i, x, label) in enumerate(good):
        if i is None or i % every:
            continue
        scored = [(-min(max(sum(p * q for p, q in zip(x, y)), LEAST), MOST), math.inf if j is None else j, b, other == label) for b, (j, y, other) in enumerate(good) if b != a and len(x) == len(y)]
        for p, pid, *_ in sorted(s for s in scored if s[3])[:5]:
            near = sorted(s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(i, None if nid == math.inf else nid, -s, None if pid == math.inf else pid, -p, r) for r, (s, nid, *_) in enumerate(near, 1)]
    return sorted(out, key=repr)


def rows_with(n, seed, d=12, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, d)) * 2
    x = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * spread
    x *= rng.lognormal(size=(n, 1))
    return [(int(i), [float(c) for c in np.float32(r)], int(rng.integers(0, 4))) for i, r in zip(rng.permutation(n), x)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_rows(spark, spread, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 8000)  # many blocks
    rows = rows_with(400, 1, spread=spread)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(20)] + [rows[7], (None, rows[3][1], rows[3][2]), (None, rows[3][1], 3 - rows[3][2])]
    rows += [(2000, None, 1), (2050, [], 1), (2051, [], 2), (2052, [], 1), (2100, [0.0] * 12, 1), (2150, [NAN] * 12, 1), (2200, [INF] * 12, 1), (2250, [None] * 12, 1), (2300, rows[3][1], None), (2350, [1.0, 2.0], 1), (2351, [1.0, 2.5], 1), (2353, [1.0, 1.5], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    names, got = spark_rows(negatives.hard_negatives(df))
    assert names == ["anchor_id", "negative_id", "negative_score", "positive_id", "positive_score", "rank"]
    assert got == brute(rows) and len(got) > 40
    clash = df.selectExpr("*", "1 AS rank", "2 AS score", "'x' AS v", "3 AS d", "4 AS positives")
    assert spark_rows(negatives.hard_negatives(clash))[1] == got
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_numbers_beyond_a_float(spark):
    rows = [(50, [3e7, 1.0, 2e7], 1), (51, [2e7, 3.0, 2e7], 1), (52, [1e7, 5.0, 2e7], 2), (53, [1e7, 5.0, 1.9e7], 2), (54, [1.5e7, 0.0, 1e7], 1), (55, [1e30, 1.0, 1.0], 1), (56, [1e29, 1.0, 1.0], 3), (57, [1e25, 1.0, 1.0], 3)]
    assert spark_rows(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)))[1] == brute(rows)


def test_lists_leave_rows_out_and_lose_none():
    """Buckets of one direction: candidates are few, and none that reaches the cosine is missing."""
    rng = np.random.default_rng(5)
    centre = np.eye(8)
    x = centre[rng.integers(0, 8, 400)] * 50 + rng.normal(size=(400, 8))
    bucket = negatives.Bucket(x, np.linalg.norm(x, axis=1))
    q = centre + rng.normal(size=(8, 8)) * 0.02
    q /= np.linalg.norm(q, axis=1)[:, None]
    cosine = np.full(8, 0.95)
    looked, found = 0, set()
    for a, r in bucket.candidates(q, cosine):
        assert r is not None
        looked += len(a)
        found |= set(zip(a.tolist(), r.tolist()))
    true = q @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    assert {(a, r) for a, r in zip(*np.nonzero(true >= 0.95))} <= found and looked < 8 * 400 / 4


def test_oracle(spark, sf_dir):
    assert spark_rows(queries()["op12_hard_negatives"](spark, sf_dir)) == rows_of(oracle_sql()["op12_hard_negatives"], sf_dir)
