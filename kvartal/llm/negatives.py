"""Hard negatives: rows of other labels that score almost as high as an anchor's positives.

Exact search for large inner products after LEMP (Teflioudi, Gemulla and Mykytiuk, "Fast
retrieval of large entries in a matrix product", 2015). Rows lie in buckets of like length, the
longest first; a bucket keeps, for each coordinate, its rows' directions in order. A score
that an anchor still needs asks for a least cosine in a bucket. That bounds the values which
a row may have in the anchor's largest coordinates, its focus: rows inside all those ranges
of the sorted lists are verified by exact products, the rest of the bucket is not looked at.

Rows are dealt by label and length into blocks of bounded bytes, anchors likewise, and a task
searches one block of anchors in one of rows. What it returns is the best few rows of each anchor,
not pairs. Positives come first, over blocks that share a label; their scores are the bounds
of the second search, over blocks of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kvartal.scratch import Scratch

#: Rows whose vec_id is divisible by EVERY are anchors.
EVERY = 50
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: Bytes of vectors in a block, rows in a bucket, coordinates in focus.
BLOCK_BYTES, BUCKET, FOCUS = 4 << 20, 512, 3
#: Anchors whose narrowest range holds more of a bucket than this are verified against all of it at once.
WIDE = 0.25
#: Products verified at a time.
CHUNK = 1 << 16
_SLACK = 1e-9
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def whole(v: Column) -> Column:
    """Not null, every component a finite number."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows a with the rows b beside them, those beyond a long at its ends."""
    if not a.shape[1]:
        return np.zeros(len(a), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = (sum(int(x) * int(y) for x, y in zip(r, s)) for r, s in zip(a.tolist(), b.tolist()))
    return np.array([min(max(x, _LEAST), _MOST) for x in exact], np.int64)


class Bucket:
    """Rows of like length with their directions' sorted coordinate lists."""

    def __init__(self, x: np.ndarray, length: np.ndarray):
        self.x, self.longest = x, float(length.max(initial=0))
        unit = x / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.values = np.take_along_axis(unit, self.order, axis=0)
        self.rank = np.empty_like(self.order)
        np.put_along_axis(self.rank, self.order, np.broadcast_to(np.arange(len(x))[:, None], self.order.shape), axis=0)

    def candidates(self, unit: np.ndarray, cosine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchor, row) pairs that may reach the least cosines (over 0) of the anchors' directions ``unit``."""
        n, f = len(self.x), min(FOCUS, unit.shape[1])
        focus = np.argpartition(-np.abs(unit), f - 1, axis=1)[:, :f]
        c = np.take_along_axis(unit, focus, axis=1)
        mid, off = np.arccos(np.clip(c, -1, 1)), np.arccos(np.clip(cosine, -1, 1))[:, None]
        high = np.where(off >= mid, 1.0, np.cos(mid - off)) + _SLACK
        low = np.where(mid + off >= np.pi, -1.0, np.cos(mid + off)) - _SLACK
        start, end = np.zeros(c.shape, np.int64), np.zeros(c.shape, np.int64)
        for k in np.unique(focus):
            at = focus == k
            start[at] = np.searchsorted(self.values[:, k], low[at], side="left")
            end[at] = np.searchsorted(self.values[:, k], high[at], side="right")
        span = np.maximum(end - start, 0)
        best = span.argmin(axis=1)
        least = span[np.arange(len(span)), best]
        wide = np.flatnonzero(least > WIDE * n)
        for s in range(0, len(wide), max(1, (16 * CHUNK) // n)):
            yield wide[s : s + max(1, (16 * CHUNK) // n)], None
        narrow = np.flatnonzero((least > 0) & (least <= WIDE * n))
        step = max(1, (4 * CHUNK) // n)
        for s in range(0, len(narrow), step):
            own = narrow[s : s + step]
            size = least[own]
            a = np.repeat(own, size)
            at = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + start[a, best[a]]
            row = self.order[at, focus[a, best[a]]]
            for k in range(f):
                r = self.rank[row, focus[a, k]]
                on = (r >= start[a, k]) & (r < end[a, k])
                a, row = a[on], row[on]
            yield a, row


class Best:
    """The k best (score, then least id) of each anchor and window."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), _LEAST, np.int64)
        self.row = np.full((*low.shape, k), -1, np.int64)

    def need(self) -> np.ndarray:
        """The least score that any window of an anchor still takes, as a float that is not above it; inf if none takes any."""
        full = self.row[:, :, -1] >= 0
        least = np.where(full, np.maximum(self.low, self.score[:, :, -1]), self.low).astype(np.float64)
        return np.where(self.low <= self.high, least, np.inf).min(axis=1)

    def add(self, a: np.ndarray, row: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        """``order`` ranks the rows by id."""
        for w in range(self.low.shape[1]):
            on = (score >= self.low[a, w]) & (score <= self.high[a, w]) & ((self.row[a, w, -1] < 0) | (score >= self.score[a, w, -1]))
            if not on.any():
                continue
            hit = np.unique(a[on])
            had = self.row[hit, w] >= 0
            x = np.concatenate((a[on], np.repeat(hit, self.k)[had.ravel()]))
            r = np.concatenate((row[on], self.row[hit, w][had]))
            s = np.concatenate((score[on], self.score[hit, w][had]))
            by = np.lexsort((order[r], ~s, x))
            x, r, s = x[by], r[by], s[by]
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            nth = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate((first, [len(x)]))))
            keep = nth < self.k
            self.score[hit, w], self.row[hit, w] = _LEAST, -1
            self.score[x[keep], w, nth[keep]], self.row[x[keep], w, nth[keep]] = s[keep], r[keep]


def search(anchors: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, fits, order: np.ndarray) -> Best:
    """The k best rows of each anchor in each of its windows [low, high] of scores, of those that ``fits(anchors, rows)`` allows."""
    best = Best(low, high, k)
    with np.errstate(over="ignore", invalid="ignore"):
        length, lengths = (np.sqrt((x * x).sum(axis=1)) for x in (anchors, rows))
        unit = anchors / np.where(length > 0, length, 1)[:, None]
        down = np.argsort(-lengths, kind="stable")
        for s in range(0, len(down), BUCKET):
            own = down[s : s + BUCKET]
            bucket = Bucket(rows[own], lengths[own])
            need = best.need()
            reach = length * bucket.longest
            live = np.flatnonzero((need <= reach * (1 + _SLACK) + _SLACK) & (need < np.inf))
            if not len(live):
                continue
            cosine = np.where(reach[live] > 0, need[live] / np.where(reach[live] > 0, reach[live], 1), -1.0)
            # a score of 0 or less asks nothing of a direction; nor do lengths beyond a float
            ask = (cosine > 0) & np.isfinite(reach[live])
            free = live[~ask]
            step = max(1, (16 * CHUNK) // len(own))
            found = [(free[t : t + step], None) for t in range(0, len(free), step)]
            some = live[ask]
            if len(some):
                found += [(some[a], r) for a, r in bucket.candidates(unit[some], cosine[ask])]
            for a, r in found:
                if r is None:
                    _verify_all(best, anchors, a, rows, own, fits, order)
                    continue
                for t in range(0, len(a), CHUNK):
                    x, y = a[t : t + CHUNK], own[r[t : t + CHUNK]]
                    on = fits(x, y)
                    x, y = x[on], y[on]
                    best.add(x, y, products(anchors[x], rows[y]), order)
    return best


def _verify_all(best: Best, anchors: np.ndarray, a: np.ndarray, rows: np.ndarray, own: np.ndarray, fits, order: np.ndarray) -> None:
    """Anchors with a whole bucket: one matrix product tells the pairs that still count."""
    x, y = anchors[a], rows[own]
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1] < 2.0**53:
        scores = x @ y.T
        i, j = np.nonzero(scores >= best.need()[a][:, None])
        score = scores[i, j].astype(np.int64)
        on = fits(a[i], own[j])
        best.add(a[i][on], own[j][on], score[on], order)
        return
    i, j = (z.ravel() for z in np.meshgrid(a, own, indexing="ij"))
    on = fits(i, j)
    i, j = i[on], j[on]
    best.add(i, j, products(anchors[i], rows[j]), order)


_FOUND = "a_rid long, anchor_id long, positive_id long, positive_score long, at int, rid long, vec_id long, score long"


def _task(k: int, same: bool):
    schema = pa.schema([(n, pa.int32() if n == "at" else pa.int64()) for n in (c.split()[0] for c in _FOUND.split(", "))])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy()
        a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return np.floor(256 * flat.reshape(t.num_rows, int(t.column("d")[0].as_py())))

        ids = np.array([_MOST if v is None else v for v in b.column("vec_id").to_pylist()], np.int64)
        order = np.empty(len(ids), np.int64)
        order[np.lexsort((b.column("rid").to_numpy(), ids))] = np.arange(len(ids))
        la, lb, ra, rb = (t.column(c).to_numpy() for c in ("label", "rid") for t in (a, b))
        asked = a.column("positives").to_pylist()
        n = max(len(p or ()) for p in asked) if not same else 1
        low, high = np.full((len(asked), n), _MOST), np.full((len(asked), n), _LEAST)
        if same:
            low[:], high[:] = _LEAST, _MOST
        else:
            for i, p in enumerate(asked):
                for w, x in enumerate(p or ()):
                    low[i, w], high[i, w] = -(-x["score"] // 2), 95 * x["score"] // 100
        fits = (lambda i, j: (la[i] == lb[j]) & (ra[i] != rb[j])) if same else (lambda i, j: la[i] != lb[j])
        best = search(matrix(a), matrix(b), low, high, k, fits, order)
        i, w, r = np.nonzero(best.row >= 0)
        row = best.row[i, w, r]
        own = pa.array(i)
        of = [asked[x][y] for x, y in zip(i, w)] if not same else [{"vec_id": None, "score": None}] * len(i)
        cols = [
            a.column("rid").take(own), a.column("vec_id").take(own), pa.array([x["vec_id"] for x in of], pa.int64()), pa.array([x["score"] for x in of], pa.int64()), pa.array(w.astype(np.int32)),
            b.column("rid").take(pa.array(row)), b.column("vec_id").take(pa.array(row)), pa.array(best.score[i, w, r]),
        ]
        return pa.table(cols, schema=schema)

    return run


def _dealt(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, a line for each block with its labels)."""
    size = rows.agg(F.sum(8 + 8 * F.size("v"))).first()[0] or 0
    placed = rows.repartitionByRange(max(1, -(-size // BLOCK_BYTES)), "d", "label", F.col("length").desc(), "rid").withColumn("block", F.spark_partition_id())
    placed = scratch.save(placed, name)
    return placed, scratch.save(placed.groupBy("d", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")), f"{name}-blocks")


def _searched(anchors: DataFrame, rows: DataFrame, units: DataFrame, k: int, same: bool) -> DataFrame:
    """What the blocks of anchors find in the blocks of rows that ``units`` (d, ablock, block) pairs them with."""
    cols = ["d", "ablock", "block", "rid", "vec_id", "label", "v", "positives", "asks"]
    a = anchors.withColumnRenamed("block", "ablock").join(units, ["d", "ablock"]).withColumn("asks", F.lit(True))
    b = rows.join(units, ["d", "block"]).withColumn("asks", F.lit(False)).withColumn("positives", F.lit(None).cast("array<struct<vec_id:long,score:long>>"))
    return a.select(*cols).unionByName(b.select(*cols)).groupBy("d", "ablock", "block").applyInArrow(_task(k, same), _FOUND)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor, positive and negative.

    Vectors become whole numbers, floor(256 * x); scores are their exact inner products, those beyond
    a long counting as its ends. Rows with a null label, a null vector or a component that is null or not
    finite take no part, and vectors of different lengths do not meet; empty ones score 0. A zero
    vector takes part. Repeated rows are rows: they are each other's positives. A row without
    vec_id is no anchor and comes last among equals. Positives below 0 have no negatives. Anchors
    without a positive, and positives without a negative, have no row. No rows: no rows. Other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    v, label = F.col("embedding").cast("array<double>"), F.col("label").cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v")).where(whole(F.col("v")) & F.col("label").isNotNull())
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.select("vec_id", moved.alias("label"), "v", F.size("v").alias("d"), length.alias("length"), F.monotonically_increasing_id().alias("rid"))
    placed, blocks = _dealt(scratch.save(rows, "rows"), scratch, "placed")
    anchors, ablocks = _dealt(placed.drop("block").where((F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()), scratch, "anchors")

    one, two = ablocks.select("d", F.col("block").alias("ablock"), F.col("least").alias("a1"), F.col("most").alias("a2")), blocks
    met = one.join(two, "d")
    shared = (F.col("a1") <= F.col("most")) & (F.col("least") <= F.col("a2"))
    other = ~((F.col("a1") == F.col("a2")) & (F.col("least") == F.col("most")) & (F.col("a1") == F.col("least")))
    near = scratch.save(met.where(shared).select("d", "ablock", "block"), "units")
    far = scratch.save(met.where(other).select("d", "ablock", "block"), "units")

    best = W.Window.partitionBy("a_rid", "at").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    first = lambda found, k: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    none = F.lit(None).cast("array<struct<vec_id:long,score:long>>")
    got = first(_searched(anchors.withColumn("positives", none), placed, near, positives, True), positives)
    got = scratch.save(got.select("a_rid", "rank", "vec_id", "score"), "positives")
    lists = got.where("score >= 0").groupBy("a_rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x.vec_id.alias("vec_id"), x.score.alias("score"))).alias("positives"))
    asked = anchors.join(lists, F.col("rid") == F.col("a_rid")).drop("a_rid")
    got = first(_searched(asked, placed, far, negatives, False), negatives)
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same by DuckDB; products of whole numbers below 2**53 are exact as doubles.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT * FROM n WHERE rank <= 3
"""
