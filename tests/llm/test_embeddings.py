import math

import numpy as np
import pytest
from oracle import rows_of, spark_rows

from kvartal.llm import embeddings
from kvartal.llm.queries import oracle_sql, queries


def brute(rows):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if i != j and la == lb and good(a, la) and good(b, lb) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        vid = rows[i][0]
        least = min(rows[k][0] for k in seen if rows[k][0] is not None) if vid is not None else None
        out.append((vid, len(links[i]), least, vid is not None and vid == least))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile", [512, 16])
def test_rows(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", tile * 512)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 40))
    rows = [(int(i), [float(x) for x in np.float32(base[i % 6] + rng.normal(size=40) * rng.uniform(0, 0.5))], int(i % 2)) for i in rng.permutation(150)]
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(5)] + [rows[3]]
    nan, inf = float("nan"), float("inf")
    rows += [(600, None, 1), (601, [0.0] * 40, 1), (602, [nan] * 40, 1), (603, [inf] + [1.0] * 39, 1), (604, [None] + [1.0] * 39, 1), (605, rows[3][1], None), (606, [], 1), (607, [1.0, 2.0], 1), (608, [1.0, 2.1], 1), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=repr)
    assert got == brute([(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b], c) for a, b, c in rows])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_oracle(spark, sf_dir):
    assert spark_rows(queries()["op4_embeddings"](spark, sf_dir)) == rows_of(oracle_sql()["op4_embeddings"], sf_dir)
