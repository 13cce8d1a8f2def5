"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a random key from its own contents, which orders its source. A source
of S words with a target of T words is read floor(T / S) times whole, and once more up to
the remainder. The order is cut into blocks by the leading bits of the key; block sizes
say how many blocks the remainder has whole, and the block at its edge is cut again into
smaller ones until few documents are left; those of them that still fit are the last block.

So each source has an exact quota of blocks in its permuted order. A binary tree over the
output shards splits the quotas: the left half of a node's shards gets its share of the
node's blocks by a multivariate-hypergeometric draw, the right half the rest. A shard owns
the next blocks in the order of each source, disjoint from other shards', and is shuffled
locally by key. What the mix takes of a document is the blocks with it that shards own.

The driver holds one record for each source (a catalogue), and block sizes of one at a time.

Main path: DataFrame operations only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvartal.llm.names import fresh
from kvartal.scratch import Scratch

NAMES = ("size", "source_size", "target", "taken", "shards")
WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
SHARDS = 16
#: Blocks are cut by this many bits at a time; an edge of at most CELL rows is not cut again.
BITS, CELL = 8, 512
_KEY_BITS = 63
#: Bytes of a plan's table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")), F.lit(0)).cast("long")


def key_of(seed: int) -> Column:
    """A document's place in the order of its source: 63 random bits, alike for equal rows."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))
    return h.bitwiseAND(F.lit((1 << _KEY_BITS) - 1))


@dataclass
class Share:
    """What the mix takes of one source."""

    source: str | None
    size: int
    rows: int
    target: float = 0.0
    times: int = 0
    rest: int = 0
    cut: int = 0  # keys below are in whole blocks of the last round
    end: int = 0  # keys from cut up to here are the edge
    blocks: int = 0
    levels: list[tuple[int, int, int, int]] = field(default_factory=list)  # keys from, up to, bits of a block, blocks before
    bounds: list[int] = field(default_factory=list)  # of the shards, in blocks


def targets(sizes: list[int], weights: list[int], most: int = MOST_TIMES) -> list[float]:
    """All words shared by weight; none above ``most`` times its size, the excess reshared."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Block counts by shard and source: the leaves of the splitting tree."""
    out: list[list[int]] = [[] for _ in range(shards)]

    def descend(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q.tolist()
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * 65536 + hi]))
        n, k = int(q.sum()), int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(q)
        for i, x in enumerate(q.tolist()):  # one hypergeometric draw a source, given those before
            if n and k:
                left[i] = rng.hypergeometric(x, n - x, k) if n - x else min(x, k)
            n, k = n - x, k - int(left[i])
        descend(left, lo, mid)
        descend(q - left, mid, hi)

    descend(np.array(quotas, dtype=np.int64), 0, shards)
    return out


def _small(df: DataFrame, scratch: Scratch) -> DataFrame:
    return F.broadcast(df) if scratch.size(df) <= BROADCAST_BYTES else df


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A catalogue of the driver's as rows that the plan itself holds: no Python worker makes them, and one task writes them."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>", {"mode": "FAILFAST"})
    return spark.range(0, 1, 1, 1).select(F.explode(parsed).alias("r")).select("r.*")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _inside(slim: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """Documents whose key lies between lo and hi of their source's row."""
    edges = _literal(slim.sparkSession, rows, f"s:string,lo:bigint,hi:bigint{schema}")
    edges = F.broadcast(edges) if sum(40 + 4 * len(r["s"] or "") for r in rows) <= BROADCAST_BYTES else edges
    return slim.join(edges, _same(F.col("source"), F.col("s")) & F.col("u").between(F.col("lo"), F.col("hi")))


def _cells(slim: DataFrame, open_: list[Share], shift: int):
    """(source, sorted (block, size, rows) inside its edge) of one source after another."""
    inside = _inside(slim, [{"s": s.source, "lo": s.cut, "hi": s.end - 1} for s in open_], "")
    cells = inside.groupBy("source", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    for source, rows in groupby(cells.orderBy("source", "cell").toLocalIterator(), lambda r: r.source):
        yield source, [(r.cell, r["size"], r.rows) for r in rows]


def plan(slim: DataFrame, shards: int, seed: int) -> tuple[list[Share], DataFrame]:
    """Shares of all sources in order, and (s, k, n, c, m): of c edge documents with key k and n words m are taken."""
    got = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    shares = sorted((Share(r.source, r["size"], r.rows) for r in got), key=lambda s: (s.source is None, s.source or ""))
    goal = targets([s.size for s in shares], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(shares))])
    for s, t in zip(shares, goal):
        s.target = t
        if s.size:
            s.times, s.rest = divmod(round(t), s.size)
        s.end = 1 << _KEY_BITS if s.rest else 0
        s.blocks = s.times << BITS
    by, shift = {s.source: s for s in shares}, _KEY_BITS
    while shift > 0 and (open_ := [s for s in shares if s.rest and s.rows > CELL]):
        shift = max(0, shift - BITS)
        for source, found in _cells(slim, open_, shift):
            s, edge, start = by[source], 0, by[source].cut
            while edge < len(found) and found[edge][1] <= s.rest:
                s.rest -= found[edge][1]
                edge += 1
            s.cut = found[edge][0] << shift if edge < len(found) else s.end
            s.levels.append((start, s.cut, shift, s.blocks))
            s.blocks += (s.cut - start) >> shift
            s.rows, last = 0, edge
            while last < len(found) and (last == edge or s.rows + found[last][2] <= CELL):
                s.rows += found[last][2]  # more documents to fill the gap from, where the block is small
                last += 1
            s.end = (found[last - 1][0] + 1) << shift if last > edge else s.cut
            s.rest *= last > edge
    for s in shares:
        s.blocks += bool(s.rest)
    leaves = split_quotas([s.blocks for s in shares], shards, seed)
    for i, s in enumerate(shares):
        s.bounds = np.cumsum([leaf[i] for leaf in leaves]).tolist()

    inside = _inside(slim, [{"s": s.source, "lo": s.cut, "hi": s.end - 1, "rest": s.rest} for s in shares if s.rest], ",rest:bigint")
    units = inside.where("size > 0").groupBy("s", "rest", "u", "size").agg(F.count("*").alias("c"))
    lists = units.groupBy("s", "rest").agg(F.array_sort(F.collect_list(F.struct("u", F.col("size").alias("n"), "c"))).alias("units"))
    none = F.array().cast("array<struct<u:bigint,n:bigint,c:bigint,m:bigint>>")

    def add(a: Column, x: Column) -> Column:
        m = F.least(x.c, F.floor(a.gap / x.n))
        taken = F.concat(a["take"], F.array(F.struct(x.u.alias("u"), x.n.alias("n"), x.c.alias("c"), m.alias("m"))))
        # the least one left over, with what is taken of its equals
        spare = F.when((m < x.c) & (a.spare.isNull() | (x.n < a.spare.n)), F.struct(x.n.alias("n"), x.u.alias("u"))).otherwise(a.spare)
        return F.struct((a.gap - m * x.n).alias("gap"), taken.alias("take"), spare.alias("spare"))

    start = F.struct(F.col("rest").alias("gap"), none.alias("take"), F.lit(None).cast("struct<n:bigint,u:bigint>").alias("spare"))
    # one more where that comes nearer than leaving the gap
    more = lambda a, x: x.m + F.when((x.u == a.spare.u) & (x.n == a.spare.n) & (x.n < 2 * a.gap), 1).otherwise(0)
    fits = F.aggregate("units", start, add, lambda a: F.transform(a["take"], lambda x: F.struct(x.u.alias("k"), x.n.alias("n"), x.c.alias("c"), more(a, x).alias("m"))))
    return shares, lists.select("s", F.explode(fits).alias("x")).select("s", "x.*").where("m > 0")


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = 0, whole_rows: bool = False, names: tuple[str, ...] = NAMES) -> DataFrame:
    """Every row with its size, source_size, target, taken and shards (one for each time it is taken), called ``names``.

    Without ``whole_rows`` only doc_id and source come along; with it all columns do,
    other than those of ``names``. Null and wordless texts have size 0 and are never taken.
    A null source is a source, the last in order. Equal rows (doc_id, source and text)
    cannot be told apart: of them as many are taken as the edge of their source asks for,
    whichever they are. A source comes as near its target as its documents fit: within half
    the least document left over at the edge. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size, source_size, target, taken, shard_names = names
    taken_names = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in taken_names] if whole_rows else ["doc_id", "source"]
    sized = docs.select(*(F.col(c).cast("string").alias(c) if c.lower() == "source" else F.col(c) for c in keep), *(() if whole_rows else ("text",)), size_of(F.col("text")).alias(size))
    u, s, by_, pick, rid, rank = fresh([*keep, *names], "u", "s", "by", "pick", "rid", "rank")
    sized = sized.withColumn(u, key_of(seed))
    slim = scratch.save(sized.select("doc_id", "source", F.col(size).alias("size"), F.col(u).alias("u")), "sizes")
    shares, picks = plan(slim, shards, seed)
    picks = scratch.save(picks, "edges")

    level = lambda v: dict(zip(("lo", "hi", "bits", "before"), v))
    rows = [{"s": x.source, "p": {"size": x.size, "target": x.target, "times": x.times, "levels": [level(v) for v in x.levels], "blocks": x.blocks, "bounds": x.bounds}} for x in shares]
    plan_type = "size:bigint,target:double,times:bigint,levels:array<struct<lo:bigint,hi:bigint,bits:int,before:bigint>>,blocks:bigint,bounds:array<bigint>"
    by = scratch.save(_literal(docs.sparkSession, rows, f"s:string,p:struct<{plan_type}>"), "shares")
    by = _small(by, scratch).select(F.col("s").alias(s), F.col("p").alias(by_))
    all_ = sized if whole_rows else slim.select("doc_id", "source", F.col("size").alias(size), F.col("u").alias(u))
    all_ = all_.join(by, _same(F.col("source"), F.col(s))).drop(s)
    x = _small(picks, scratch).select(F.col("s").alias(s), F.struct("k", "n", "c", "m").alias(pick))
    picked = F.col(pick)
    all_ = all_.join(x, _same(F.col("source"), F.col(s)) & (F.col(u) == picked.k) & (F.col(size) == picked.n), "left").drop(s)
    whole = all_.where(picked.isNull() | (picked.m == picked.c)).withColumn(rank, F.lit(0).cast("long"))
    if not picks.where("m < c").isEmpty():
        # equal rows of which some are taken: numbered by the tasks that wrote them, each from where the one before ended
        part = scratch.save(all_.where(picked.m < picked.c).withColumn(rid, F.monotonically_increasing_id()), "equal")
        task = F.shiftright(rid, 33)
        counts = part.groupBy("source", u, size, task.alias("t")).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source", u, size).orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
        before = scratch.save(counts.select(F.col("source").alias(s), F.col(u).alias("bu"), F.col(size).alias("bn"), "t", F.coalesce(before, F.lit(0)).alias("before")), "before")
        own = F.row_number().over(Window.partitionBy("source", u, size, task).orderBy(rid)) - 1
        cols = part.columns
        numbered = part.withColumn(rank, own.cast("long")).alias("p").join(
            _small(before, scratch).alias("b"),
            _same(F.col("p.source"), F.col(f"b.{s}")) & (F.col(f"p.{u}") == F.col("b.bu")) & (F.col(f"p.{size}") == F.col("b.bn")) & (F.shiftright(F.col(f"p.{rid}"), 33) == F.col("b.t")),
        )
        numbered = numbered.select(*(F.col(f"p.{c}") for c in cols if c != rid), (F.col(f"p.{rank}") + F.col("b.before")).alias(rank))
        whole = whole.unionByName(numbered)
    p, key = F.col(by_), F.col(u)
    rounds = F.when(p.times > 0, F.transform(F.sequence(F.lit(0).cast("long"), p.times - 1), lambda r: F.shiftleft(r, BITS) + F.shiftright(key, _KEY_BITS - BITS)))
    found = F.filter(p.levels, lambda v: (v.lo <= key) & (key < v.hi))
    last = F.transform(found, lambda v: v.before + F.call_function("shiftright", key - v.lo, v.bits))
    edge = F.when(F.col(rank) < picked.m, F.array(p.blocks - 1))
    nothing = F.array().cast("array<bigint>")
    blocks = F.when(F.col(size) > 0, F.concat(*(F.coalesce(b, nothing) for b in (rounds, last, edge)))).otherwise(nothing)
    drawn = F.transform(blocks, lambda b: F.size(F.filter(p.bounds, lambda end: end <= b)))
    drawn = F.filter(drawn, lambda k: k < shards)  # blocks that no shard owns are not taken
    out = whole.select(*(F.col(c) for c in keep), size, p.getField("size").alias(source_size), p.target.alias(target), drawn.alias(shard_names))
    return out.withColumn(taken, F.col(size) * F.size(shard_names)).select(*keep, *names)


def draw(mixed: DataFrame, seed: int = 0, shards: str = "shards") -> DataFrame:
    """The rows that ``mix`` with whole rows takes: one for each time, with copy and shard, shuffled inside its shard.

    ``shards`` names the column that ``mix`` made. Columns named copy or shard are replaced.
    """
    keep = [c for c in mixed.columns if c.lower() not in ("copy", "shard")]
    (o,) = fresh([*keep, "copy", "shard"], "o")
    each = mixed.select(*keep, F.posexplode(shards).alias("copy", "shard"))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text", "copy")
    # a shard is cut into ranges of its random order, so that none needs one large task
    return each.withColumn(o, order).repartitionByRange("shard", o).sortWithinPartitions("shard", o).drop(o)


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: a row for each time a document is taken, shuffled inside its shard."""
    return draw(mix(docs, shards, seed, whole_rows=True), seed).drop("shards")
