import random
import re
from collections import Counter, defaultdict

import pytest
from oracle import rows_of, spark_rows

from kvartal.llm import divergence
from kvartal.llm.queries import oracle_sql, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in df:
        kept = sorted((w for w, n in df[lang].items() if n >= least), key=lambda w: w.encode())
        own = {s: c for (l2, s), c in counts.items() if l2 == lang}

        def share(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in own if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if own[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(item, lang, part, k, s, -v) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


def rows_with(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["Über", "uber", "the", "THE", "a", "é", "日本", "x" * 3000, "mid", "rare", *(f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9))]
    rows = []
    for _ in range(n):
        words = [vocabulary[min(int(rng.expovariate(0.05)), len(vocabulary) - 1)] for _ in range(rng.randint(0, 30))]
        source = "hot" if rng.random() < 0.35 else rng.choice(["s1", "s2", "é", None, ""])
        rows.append((rng.choice([" ", "-", "1", "\n"]).join(words), rng.choice(["en", "en", "de", "a\0b", None, ""]), source))
    rows += [(None, "en", "s1"), ("", "en", "only"), ("!! 12 \t", "xx", "s1"), (None, None, None), ("word " * 50, "one", "s1")]
    rows += [("same words here and there", "dup", f"s{k % 2}") for k in range(30)] + [("tie", "t", "a")] * 10 + [("tie", "t", "b")] * 10
    return rows


SCHEMA = "text string, lang string, source string"


@pytest.mark.parametrize("small", [False, True])
def test_rows(spark, small, monkeypatch):
    if small:  # many runs, passes, slices, blocks and tiles
        for name, value in {"RUN_BYTES": 200, "SENT_BYTES": 6000, "SLICE_BYTES": 500, "BLOCK": 8, "TILE": 2}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = rows_with(1, 150 if small else 400)
    df = spark.createDataFrame(rows, SCHEMA)
    names, got = spark_rows(divergence.divergence(df))
    assert names == ["item", "lang", "part", "rank", "source", "value"]
    assert got == brute(rows, 10)


def test_odd_tables(spark):
    df = spark.createDataFrame(rows_with(2, 20), SCHEMA)
    assert divergence.divergence(df.limit(0)).count() == 0
    # no term is kept: pairs with value 0 in the order of their names
    assert spark_rows(divergence.divergence(df, least_docs=10**6))[1] == brute(rows_with(2, 20), 10**6)
    clash = df.selectExpr("*", "1 AS value", "'x' AS item", "2 AS n", "lang AS part", "3 AS rank", "4 AS ord")
    assert spark_rows(divergence.divergence(clash, least_docs=2)) == spark_rows(divergence.divergence(df, least_docs=2))


def test_oracle(spark, sf_dir):
    assert spark_rows(queries()["op13_source_divergence"](spark, sf_dir)) == rows_of(oracle_sql()["op13_source_divergence"], sf_dir)
