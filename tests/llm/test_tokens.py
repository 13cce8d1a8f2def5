import math

import regex

from kvartal.llm import tokens


def brute(raw, pieces):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(raw)
    for e in range(1, len(raw) + 1):
        for s in range(e):
            if raw[s:e] in pieces:
                best[e] = max(best[e], (best[s][0] + pieces[raw[s:e]], best[s][1] - 1))
    return -best[-1][1]


def test_forward_scores_match_brute_force():
    pieces = tokens.load()
    words = {"a", " the", " there", " theretofore", "Ñandú", " \n\n", "🙂🙂", "xq" * 40, " 12345", ""}
    assert tokens.count_distinct(words, tokens.endings(pieces)) == {w: brute(w.encode(), pieces) for w in words}


def test_rows(spark, sf_dir):
    pieces, find = tokens.load(), regex.compile(tokens.PATTERN).findall
    texts = [None, "", "One two, THREE 44!", "x" * 3000, "é ü\n\n  z", "One two, THREE 44!"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id int, text string, n_tokens int")
    got = {r.doc_id: tuple(r)[1:] for r in tokens.count_tokens(docs).collect()}
    for i, t in enumerate(texts):
        parts = find(t or "")
        assert got[i] == (len(parts), sum(brute(p.encode(), pieces) for p in parts), len((t or "").encode()))
    assert got[None][1] == 1 and tokens.count_tokens(docs.limit(0)).count() == 0
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2000").limit(20)
    want = {r.doc_id: sum(brute(p.encode(), pieces) for p in find(r.text)) for r in some.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(some).collect()} == want
