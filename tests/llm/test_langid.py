import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kvartal.llm import langid


def grams(text):
    padded = "".join(c if c.isalpha() else " " for c in text.lower())
    out = Counter()
    for w in padded.split():
        w = f" {w} "
        for k in (1, 2, 3):
            out.update(w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k] != " ")
    return out


def decode(code):
    code, cps = int(code), []
    while code:
        cps.append(code & 0x1FFFFF)
        code >>= 21
    return "".join(chr(c) if c else " " for c in reversed(cps))


def test_grams_match_brute_force():
    text = "Él niño, corrió 22 x!"
    codes, n = np.unique(langid._codes(langid._points(text)), return_counts=True)
    want = Counter()
    for g, c in grams(text).items():  # words share the gap between them
        want[g.lstrip() if g.startswith(" ") and len(g.strip()) == 0 else g] += c
    got = {}
    for c, k in zip(codes, n):
        got[decode(c)] = got.get(decode(c), 0) + int(k)
    lead = {g.lstrip(" "): 0 for g in want}
    for g, c in want.items():
        lead[g.lstrip(" ")] += c
    assert got == lead


def test_rows(spark):
    rows = [(i, "der und die ist nicht zu", "de", 1.0) for i in range(20)] + [(i, "the and of that is with", "en", 1.0) for i in range(20, 40)]
    rows += [(90, None, "de", 1.0), (91, "", "en", 1.0), (92, "123 !!", None, 1.0), (93, "The " * 30000, None, 1.0), (None, "und der", "de", 1.0), (93, "The " * 30000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 30, 90, 91, 92, 93, None)] == ["de", "en", "und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and by[None].held_out is False
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(40))
    assert langid.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark, sf_dir):
    from kvartal.llm.queries import queries

    d = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [r for r in queries()["op5_language_id"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == d[r.doc_id] for r in got) >= 0.95 * len(got)


def _grams(text):
    """Codes of the 1- to 3-grams of a text's letters, a run of others being one gap; written out for one place after another."""
    places, out = [0], []
    for c in text.lower():
        if c.isalpha():
            places.append(ord(c))
        elif places[-1]:
            places.append(0)
    if places[-1]:
        places.append(0)
    for k in (1, 2, 3):
        for i in range(len(places) - k + 1):
            part = places[i : i + k]
            if any(part) and (k < 3 or part[1]):
                code = 0
                for p in part:
                    code = code << 21 | p
                out.append(code)
    return out


def test_query_against_profiles_made_by_hand(spark, sf_dir):
    import zlib
    from collections import Counter, defaultdict

    from kvartal.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    out = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 4 == 2 for d in docs}
    counts, own = defaultdict(Counter), {}
    for d in docs:
        own[d.doc_id] = Counter(_grams(d.text or ""))
        if not out[d.doc_id] and d.lang is not None and d.text is not None:
            counts[d.lang].update(own[d.doc_id])
    top = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE]]
    profiles = {lang: {g: r for r, g in enumerate(top(c))} for lang, c in sorted(counts.items()) if c}
    for r in queries()["op5_language_id"](spark, sf_dir).collect():
        mine = top(own[r.doc_id])
        if not mine:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        far = sorted((sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(mine)), lang) for lang, p in profiles.items())
        assert r.lang_pred == far[0][1] and r.held_out == out[r.doc_id]
        assert abs(r.score - (far[1][0] - far[0][0]) / far[1][0]) < 1e-12
