"""Approximate nearest neighbours by a permutation index.

Amato, Gennaro and Savino, "MI-File: using inverted files for scalable approximate similarity
search" (2014): a vector is the list of its nearest pivots in order. Near vectors see the
pivots in nearly the same order, so the footrule distance of two lists (how far each pivot
moved) tells which vectors are worth an exact distance. Vectors are posted in the inverted
files of their first pivots; a query reads the files of its own first ones.

Pivots are a bounded sample: the different vectors of least hash, ``pivots_for`` of them. Every vector
is posted. Files are dealt out in parts of at most about ``PART`` postings and ``BATCH`` queries, so a
file that many copies share is many tasks. A posting holds its whole list, so a part ranks by
footrule and reranks by itself, and returns ``k`` rows a query. A vector that a query meets
in several files counts in the one whose pivot is nearest to the query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from kvartal.scratch import Scratch

#: Neighbours of a query; one row in EVERY is a query.
K, EVERY = 10, 100
#: Pivots: at least LEAST, twice the root of the number of vectors, at most MOST and PIVOT_BYTES.
LEAST, MOST, PIVOT_BYTES = 512, 16384, 32 << 20
#: Pivots in a list, files that a vector is posted in, files that a query reads.
LENGTH, POSTED, READ = 128, 24, 24
#: Of the postings that a query meets in a part, FLOOR and this share, nearest by footrule, are reranked.
FLOOR, SHARE = 64, 0.15
#: Postings and queries in a part.
PART, BATCH = 16384, 4096
#: Rows projected at a time.
ROWS = 1024


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, every component a finite number."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def pivots_for(n: int, width: int) -> int:
    """How many of n vectors with ``width`` components are pivots."""
    return min(n, MOST, max(LEAST, 2 * math.isqrt(n)), max(1, PIVOT_BYTES // (8 * width)))


def _choose(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of the commonest lengths of vectors, PIVOT_BYTES in all: a length without any is searched whole."""
    out, left = {}, PIVOT_BYTES
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()
    for r in sizes:
        most = min(pivots_for(r.n, r.d), left // (8 * r.d))
        if not most:
            continue
        own = rows.where(F.col("d") == r.d)
        hashes = [x.h for x in own.select("h").distinct().orderBy("h").limit(most).collect()]
        found = own.where(F.col("h") <= hashes[-1]).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(most).collect()
        out[r.d] = np.array([x.v for x in found], dtype=np.float64)
        left -= out[r.d].nbytes
    return out


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest LENGTH pivots of each row, nearest first, ties by the pivot's number."""
    length = min(LENGTH, len(pivots))
    d2 = (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    if length < len(pivots):
        some = np.sort(np.argpartition(d2, length - 1, axis=1)[:, :length], axis=1)
    else:
        some = np.broadcast_to(np.arange(len(pivots)), d2.shape)
    near = np.argsort(np.take_along_axis(d2, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, near, axis=1).astype(np.int16)


def _lists(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                size = b.column("d").to_numpy()
                lists: list = [None] * b.num_rows
                for d in np.unique(size):
                    if int(d) in pivots:
                        own = np.flatnonzero(size == d)
                        for i, row in zip(own, orders(_matrix(b.column("v").take(pa.array(own))), pivots[int(d)])):
                            lists[i] = row
                    else:
                        for i in np.flatnonzero(size == d):
                            lists[i] = np.zeros(0, np.int16)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.int16()))], names=[*b.schema.names, "list"])

    return run


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64 if flat.dtype.kind == "f" else flat.dtype)


def footrule(place: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """Induced footrule distances of rows of ``lists`` to the list whose places are ``place`` (its length where absent)."""
    length = lists.shape[1]
    at = place[lists]
    # a pivot of the query that a list lacks counts as at the end there
    return np.abs(at - np.arange(length)).sum(axis=1) + length * (length + 1) // 2 - (length - at).sum(axis=1)


def part_nearest(file: int, lists: np.ndarray, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, q_lists: np.ndarray, q: np.ndarray, q_rids: np.ndarray, read: np.ndarray, k: int, posted: int = POSTED, share: float = SHARE):
    """(query, index of the vector, distance) of the k best of each query among a file's postings."""
    out = []
    whole = lists.shape[1] == 0
    m = int(max(lists.max(initial=-1), q_lists.max(initial=-1))) + 1
    for i in range(len(q)):
        if whole:
            own = np.flatnonzero(rids != q_rids[i])
        else:
            length = lists.shape[1]
            place = np.full(m, length, np.int32)
            place[q_lists[i]] = np.arange(length)
            # this file is the first for a posting if no nearer pivot that the query reads has it too
            mine = place[file] if read[i] >= 0 else file
            ranks = place[lists[:, :posted]] if read[i] >= 0 else lists[:, :posted].astype(np.int32)
            own = np.flatnonzero((ranks.min(axis=1) == mine) & (rids != q_rids[i]))
            best = max(FLOOR, k) + int(share * len(own))
            if best < len(own):
                far = footrule(place, lists[own])
                own = own[np.argpartition(far, best - 1)[:best]] if best else own[:0]
        if not len(own):
            continue
        gap = x[own] - q[i]
        d = np.sqrt((gap * gap).sum(axis=1))
        first = np.lexsort((ids[own], d))[:k]
        out.append((np.full(len(first), i), own[first], d[first]))
    return out


def _search(k: int, n_posted: int, share: float):
    schema = pa.schema([("q_rid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        col = lambda c: table.column(c).combine_chunks()
        a, b = pa.array(np.flatnonzero(asks)), pa.array(np.flatnonzero(~asks))
        if not len(a) or not len(b):
            return schema.empty_table()
        ids = np.array([(1 << 63) - 1 if v is None else v for v in col("vec_id").take(b).to_pylist()], np.int64)
        real = col("vec_id").take(b)
        rid = col("rid").to_numpy()
        q_rids, rids = rid[np.asarray(a)], rid[np.asarray(b)]
        read = col("read").to_numpy()[np.asarray(a)]
        lists, q_lists = _matrix(col("list").take(b)), _matrix(col("list").take(a))
        got = part_nearest(int(col("file")[0].as_py()), lists, _matrix(col("v").take(b)), ids, rids, q_lists, _matrix(col("v").take(a)), q_rids, read, k, n_posted, share)
        if not got:
            return schema.empty_table()
        i, j, d = (np.concatenate(z) for z in zip(*got))
        asked = col("vec_id").take(a)
        return pa.table([pa.array(q_rids[i]), asked.take(pa.array(i)), real.take(pa.array(j)), pa.array(d)], schema=schema)

    return run


def _met(asked: DataFrame, posted: DataFrame, parts: DataFrame, k: int, n_posted: int, share: float) -> DataFrame:
    """The k best of each query in every part of the files that it reads."""
    mine = asked.join(parts, ["d", "file"])
    mine = mine.withColumn("batch", F.pmod(F.xxhash64("rid"), "batches")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    theirs = posted.join(parts, ["d", "file"]).withColumn("part", F.pmod(F.xxhash64("rid"), "parts")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"))
    cols = ["d", "file", "part", "batch", "rid", "vec_id", "v", "list", "read"]
    both = mine.select(*cols, F.lit(True).alias("asks")).unionByName(theirs.select(*cols, F.lit(False).alias("asks")))
    return both.groupBy("d", "file", "part", "batch").applyInArrow(_search(k, n_posted, share), "q_rid long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, n_posted: int = POSTED, n_read: int = READ, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row whose vec_id is divisible by ``every``.

    Nearness is the Euclidean distance of the vectors as given; ties go to the smaller vec_id. Vectors
    that are null, empty, zero or hold a null or a number that is not finite take no part,
    and vectors of different lengths do not meet. A row is every other row's candidate, so
    repeated rows find each other; a row without vec_id is a candidate, last among equals, and
    no query. A query that finds fewer than k in the files that it reads, while there are more,
    reads all files. No rows: no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(usable(v))
    rows = rows.select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.monotonically_increasing_id().alias("rid"))
    rows = scratch.save(rows, "rows")
    pivots = _choose(rows)
    schema = T.StructType([*rows.schema, T.StructField("list", T.ArrayType(T.ShortType()))])
    listed = scratch.save(rows.mapInArrow(_lists(pivots), schema).drop("h"), "lists")

    asks = (F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()
    file = lambda n: F.explode(F.when(F.size("list") == 0, F.array(F.lit(-1).cast("short"))).otherwise(F.slice("list", 1, n))).alias("file")
    cols = ["rid", "vec_id", "v", "d", "list", F.lit(0).alias("read")]
    posted, asked = listed.select(*cols, file(n_posted)), listed.where(asks).select(*cols, file(n_read))
    sizes = listed.select("d", file(n_posted)).groupBy("d", "file").agg(F.count("*").alias("n"))
    queries = listed.where(asks).select("d", file(n_read)).groupBy("d", "file").agg(F.count("*").alias("m"))
    parts = sizes.join(queries, ["d", "file"]).select("d", "file", F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.col("m") / BATCH).alias("batches"))
    parts = scratch.save(parts, "parts")
    order = W.Window.partitionBy("q_rid").orderBy("score", F.col("vec_id").asc_nulls_last())
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = scratch.save(best(_met(asked, posted, parts, k, n_posted, share)), "found")

    # queries that met too few read every file
    there = listed.groupBy("d").agg(F.count("*").alias("there"))
    had = found.groupBy("q_rid").agg(F.count("*").alias("had"))
    few = listed.where(asks).join(there, "d").join(had, F.col("rid") == F.col("q_rid"), "left")
    few = scratch.save(few.where(F.coalesce("had", F.lit(0)) < F.least(F.lit(k), F.col("there") - 1)).select("rid", "vec_id", "v", "d", "list", F.lit(-1).alias("read")), "few")
    if not few.isEmpty():
        every_file = scratch.save(sizes, "files")
        wide = few.join(every_file.select("d", "file"), "d")
        m = wide.groupBy("d", "file").agg(F.count("*").alias("m"))
        all_parts = every_file.join(m, ["d", "file"]).select("d", "file", F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.col("m") / BATCH).alias("batches"))
        again = scratch.save(best(_met(wide, posted, scratch.save(all_parts, "parts"), k, n_posted, share)), "again")
        found = found.join(few.select(F.col("rid").alias("q_rid")), "q_rid", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
