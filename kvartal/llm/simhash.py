"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints within ``MAX_BITS`` differing bits are linked; the result is each
document's component. Distribution: 64 bits fall into six blocks, and four errors
leave at least two blocks whole, so every linked pair meets in one of the fifteen
groups that agree on two blocks (20 to 22 bits). A group of more than MOST fingerprints is
split by further bits: of five parts of the bits left over, four errors leave one whole.
Inside a group a binary trie over
the sorted fingerprints is joined with itself: node pairs descend together, the
bits that differ add up, and a pair is dropped as soon as they exceed the budget.

A group holds distinct fingerprints only (8 bytes each), however many documents
share them. The trie walk keeps a union-find of links found so far and skips node
pairs that already lie in one component, and each task emits a spanning forest, so
neither work nor output follows the square of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.components import components
from kvartal.llm.names import fresh
from kvartal.llm.unionfind import unite
from kvartal.scratch import Scratch

MAX_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Lengths of the six blocks, from the highest bit down.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Node pairs that one step of the trie walk holds.
STEP = 1 << 20
#: Fingerprints of a group that one walk takes; larger groups are split without losing a link.
MOST = 1 << 18
#: Bytes of a saved table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20


def fingerprint(text: str | None, words_per: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 for one without words.

    >>> fingerprint(None), fingerprint(" \\n")
    (0, 0)
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and space only
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_per, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(whole[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((ones * 2 > len(hashes)) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])


def trie_links(fps: np.ndarray, groups: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (indices a > b) of the fingerprints of equal group within max_bits.

    ``fps`` (uint64) is sorted within equal, adjacent ``groups`` and has no repeats there.
    """
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent[:0], parent[:0]
    # neighbours in sort order share the longest prefixes: their links come first and spare walks later
    near = np.flatnonzero((groups[1:] == groups[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= max_bits))
    parent = unite(parent, near + 1, near)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.append(starts[1:], n)
    keep = ends - starts > 1
    z = np.zeros(int(keep.sum()), dtype=np.int64)
    todo = [(63, starts[keep], ends[keep], starts[keep], ends[keep], z)]
    while todo:
        bit, lo1, hi1, lo2, hi2, err = todo.pop()
        if len(lo1) > STEP:
            h = len(lo1) // 2
            todo += [(bit, lo1[h:], hi1[h:], lo2[h:], hi2[h:], err[h:]), (bit, lo1[:h], hi1[:h], lo2[:h], hi2[:h], err[:h])]
            continue
        # pairs within one component have nothing to add
        turns = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        open_ = ~((turns[hi1 - 1] == turns[lo1]) & (turns[hi2 - 1] == turns[lo2]) & (parent[lo1] == parent[lo2]))
        lo1, hi1, lo2, hi2, err = (x[open_] for x in (lo1, hi1, lo2, hi2, err))
        # single leaves: the rest of the bits at once
        leaf = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        a, b = lo1[leaf], lo2[leaf]
        hit = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        parent = unite(parent, a[hit], b[hit])
        lo1, hi1, lo2, hi2, err = (x[~leaf] for x in (lo1, hi1, lo2, hi2, err))
        if bit < 0 or not len(lo1):
            continue
        m1, m2 = _split(fps, lo1, hi1, bit), _split(fps, lo2, hi2, bit)
        own = lo1 == lo2  # a node with itself: its children with themselves, and once with each other
        nxt = []
        for x_lo, x_hi, y_lo, y_hi, add in ((lo1, m1, lo2, m2, 0), (m1, hi1, m2, hi2, 0), (lo1, m1, m2, hi2, 1), (m1, hi1, lo2, m2, 1)):
            ok = (x_lo < x_hi) & (y_lo < y_hi) & (err + add <= max_bits)
            if x_lo is m1 and add:
                ok &= ~own
            ok &= ~((x_lo == y_lo) & (x_hi - x_lo == 1))
            nxt.append(tuple(x[ok] for x in (x_lo, x_hi, y_lo, y_hi, err + add)))
        todo.append((bit - 1, *(np.concatenate(x) for x in zip(*nxt))))
    b = parent
    a = np.flatnonzero(b != np.arange(n))
    return a, b[a]


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """First index in each sorted [lo, hi) whose bit is set, found by bisection of all at once."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        one = (fps[np.minimum(mid, len(fps) - 1)] >> np.uint64(bit)) & np.uint64(1) == 1
        live = lo < hi
        hi = np.where(live & one, mid, hi)
        lo = np.where(live & ~one, mid + 1, lo)
    return lo


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups of one partition, sorted by (g, fp); the last group waits for its rest."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def work() -> pa.RecordBatch:
        g, fp = (np.concatenate(x) for x in zip(*held))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        multi = np.zeros(len(g), dtype=bool)
        same = g[1:] == g[:-1]
        multi[1:] |= same
        multi[:-1] |= same
        g, fp = g[multi], fp[multi]
        a, b = trie_links(fp, g)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["a", "b"])

    for batch in batches:
        g, fp = batch.column("g").to_numpy(), batch.column("fp").to_numpy()
        if not len(g):
            continue
        if last is not None and g[0] != last and sum(len(x[0]) for x in held) >= STEP // 4:
            yield work()
            held.clear()
        cut = int(np.searchsorted(g, g[-1])) if g[0] <= g[-1] else 0
        if cut and sum(len(x[0]) for x in held) + cut >= STEP // 4:
            held.append((g[:cut], fp[:cut]))
            yield work()
            held.clear()
            held.append((g[cut:], fp[cut:]))
        else:
            held.append((g, fp))
        last = g[-1]
    if held:
        yield work()


def _groups() -> list[int]:
    """The masks of the fifteen pairs of blocks."""
    blocks, top = [], 64
    for w in BLOCKS:
        top -= w
        blocks.append(((1 << w) - 1) << top)
    return [a | b for a, b in combinations(blocks, 2)]


def _finer(mask: int) -> list[int]:
    """``mask`` with each of MAX_BITS + 1 parts of the bits that it lacks: one of them is free of errors."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part.tolist()) for part in np.array_split(free, MAX_BITS + 1) if len(part)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """(fp long) distinct fingerprints -> (a, b) links that span every component.

    A group is a mask and the bits of a fingerprint under it. Fingerprints of a group of
    more than ``most`` go to the groups of finer masks instead, in which each linked pair
    meets again, until no group is larger.
    """
    masks, rows, done = _groups(), fps.select("fp"), []
    grouped = rows.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("mask"))
    while True:
        grouped = grouped.withColumn("g", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        large = scratch.save(grouped.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("g"), "large")
        if large.isEmpty() or not any(len(_finer(m)) > 1 for m in masks):
            done.append(grouped.select("g", "fp"))
            break
        small = F.broadcast(large) if scratch.size(large) <= BROADCAST_BYTES else large
        done.append(grouped.join(small, "g", "left_anti").select("g", "fp"))
        finer = {m: _finer(m) for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        table = fps.sparkSession.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in finer.items()], "mask long, finer array<long>")
        over = grouped.join(small, "g", "left_semi").join(F.broadcast(table), "mask").select("fp", F.explode("finer").alias("mask"))
        grouped = scratch.save(over.distinct(), "finer")
    all_ = reduce(DataFrame.union, done)
    return all_.repartition("g").sortWithinPartitions("g", "fp").mapInArrow(_group_links, "a long, b long")


def simhash_components(docs: DataFrame, name: str = "simhash") -> DataFrame:
    """doc_id, h (hash of the text), fingerprint (16 hex digits), fp, component_id of every row of ``docs``.

    ``component_id`` is the least doc_id reachable, itself included. Null and blank
    texts have fingerprint zero and link like any other; a row without doc_id has a
    fingerprint and the component of its equals (null if none has an id). Repeated
    rows each keep their row; other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, name)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    rows = scratch.save(texts.mapInArrow(_fingerprints, "doc_id long, h long, fp long"), "fingerprints")
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(fingerprint_links(fps, scratch), scratch)
    named = fps.join(comp, fps.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = scratch.save(named, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = scratch.save(named.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select("doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: those whose doc_id is its least.

    Rows that share a doc_id stay or go together. Rows without doc_id go if a document
    with one is near; of those near none, each stays. Columns come through, whatever
    their names. No rows: no rows.
    """
    made = simhash_components(docs, "one-of-each")
    d, h, own = fresh(docs.columns, "d", "h", "own")
    named = made.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(d)).distinct()
    kept = docs.join(named, F.col("doc_id") == F.col(d), "left_semi")
    alone = made.where(F.col("doc_id").isNull() & F.col("component_id").isNull()).select(F.col("h").alias(h)).distinct()
    lost = docs.where(F.col("doc_id").isNull()).withColumn(own, F.xxhash64("text"))
    return kept.unionByName(lost.join(alone, F.col(own) == F.col(h), "left_semi").drop(own))
