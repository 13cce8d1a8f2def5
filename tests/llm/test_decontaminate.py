import hashlib
import re

import pytest
from oracle import rows_of, spark_rows

from kvartal.llm import decontaminate
from kvartal.llm.queries import oracle_sql, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, it in items:
            iw = words(it)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item_id)} if item_id is not None else set()
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture()
def cases():
    p = " ".join(f"w{i}" for i in range(40))
    q = "the of the of the of the of the of the of the of the of the"
    items = [(1, p), (2, p), (10, "Short Item"), (3, q), (None, " ".join(f"z{i}" for i in range(20))), (4, None), (5, "!!"), (2, "uno dos tres")]
    docs = [
        (1, p), (2, "x " + p.replace("w20", "other") + " short, ITEM!"), (3, None), (4, ""), (4, "a short item"), (4, "a short item"), (5, q + " " + q),
        (None, "z0 " + " ".join(f"z{i}" for i in range(20))), (6, ("pad " * 30000) + p), (7, " ".join(f"w{i}" for i in range(12))), (8, "É Ä w1 uno\ndos tres"),
        (9, " ".join(f"w{i}" for i in range(26, 40)) + " w0 " + " ".join(f"w{i}" for i in range(1, 13))),
    ]
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, -1])
def test_rows(spark, cases, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    docs, items = cases
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, word string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    got = sorted((tuple(r) for r in decontaminate.decontaminate(d, b).collect()), key=repr)
    assert got == brute(docs, items)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(d, b.limit(0)).collect()} == {0}


def test_oracle(spark, sf_dir):
    assert spark_rows(queries()["op1_decontaminate"](spark, sf_dir)) == rows_of(oracle_sql()["op1_decontaminate"], sf_dir)
