import random

import numpy as np
import pytest
import xxhash

from kvartal.llm import simhash
from kvartal.llm.components import components
from kvartal.scratch import Scratch


def brute_fingerprint(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words, cur = [], ""
    for c in raw + " ":
        if c in " \t\n\x0b\x0c\r":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=4):
    comp = dict(zip(ids, ids))
    change = True
    while change:
        change = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if bin(a ^ b).count("1") <= most and comp[j] < comp[i]:
                    comp[i], change = comp[j], True
    return comp


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b C", "É à ß İ A B c d", "x\x1cy z w q", "a a a a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_trie_links_match_all_pairs():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 7))) for b in base for _ in range(60)}
    fps = np.array(sorted(fps), dtype=np.uint64)
    a, b = simhash.trie_links(fps, np.zeros(len(fps)))
    ids = list(range(len(fps)))
    want = brute_components(ids, [int(x) for x in fps])
    parent = list(ids)
    for _ in ids:
        for x, y in zip(a, b):
            parent[x] = parent[y] = min(parent[x], parent[y])
    assert parent == [want[i] for i in ids]


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(5, long, 1), (3, long + " end", 2), (9, None, 3), (8, "", 4), (8, "", 4), (None, "alone here", 5), (1, "Alone Here now and then", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(simhash.simhash_components(docs).select("doc_id", "fingerprint", "component_id").collect(), key=str)
    ids = [r[0] for r in rows if r[0] is not None]
    comp = brute_components(ids, [brute_fingerprint(r[1]) for r in rows if r[0] is not None])
    want = [(r[0], f"{brute_fingerprint(r[1]):016x}", comp.get(r[0])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark, sf_dir):
    from kvartal.llm.queries import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    comp = brute_components([r.doc_id for r in docs], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries()["op7_simhash"](spark, sf_dir).collect()}
    assert got == {r.doc_id: (f"{f:016x}", comp[r.doc_id]) for r, f in zip(docs, fps)}


def test_large_groups_are_split_without_losing_a_link(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(150)})
    want = brute_components(list(range(len(fps))), fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for most in (5, 10**6):
        scratch = Scratch(spark, "split")
        comp = {r.node: r.component for r in components(simhash.fingerprint_links(df, scratch, most), scratch).collect()}
        groups, mine = {}, {}
        for i, f in enumerate(fps):
            s = int(np.uint64(f).view(np.int64))
            groups.setdefault(comp.get(s, s), []).append(i)
            mine[i] = comp.get(s, s)
        assert all(min(groups[mine[i]]) == want[i] for i in range(len(fps))), most
