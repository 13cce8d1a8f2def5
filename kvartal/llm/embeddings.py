"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of all vectors of their length, ordered within
their label along the first one, and cut into blocks of bounded bytes and those into tiles.
Two unit vectors of cosine t are at most sqrt(2 - 2t) apart, so pairs of blocks and of tiles
whose ranges along the leading axes are further apart are never formed. A block is sent
once to each block that it is near.
Inside a pair of tiles products are summed over the leading axes first; what the rest can
add is at most the product of the two vectors' remaining norms, and pairs that cannot
reach the threshold any more are left. Survivors get their cosine from the vectors as given.

Equal vectors of one label form one class that is compared once. A task reports a count of
links for each class and a spanning forest of them, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.llm.components import components
from kvartal.llm.unionfind import unite
from kvartal.scratch import Scratch

THRESHOLD = 0.93
#: Classes in a tile, the rows of a product matrix.
TILE = 512
#: Bytes of vectors in a block; a task holds two, and goes through the pairs of their tiles.
BLOCK_BYTES = 8 << 20
#: Axes whose ranges tell which blocks and tiles are near.
LEADING = 4
#: Longer vectors are compared on the axes as given: theirs would not fit the driver.
WIDEST = 4096
#: The axes are fitted on the SAMPLE classes with the least keys: any axes give the same links.
SAMPLE = 4096
#: Axes summed before each look at the bounds.
STEPS = (8, 16, 32)
_SLACK = 1e-9


def valid(v: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def axes_of(x: np.ndarray) -> np.ndarray:
    """Principal axes (columns) of unit rows, the widest first; signs are fixed."""
    _, vec = np.linalg.eigh(x.T @ x)
    vec = vec[:, ::-1]
    return vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(vec.shape[1])] < 0, -1, 1)


def turned(x: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Unit rows on the axes, or as they are without any."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return u if axes is None else u @ axes


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rows of a and b whose cosine is at least ``threshold``."""
    return _tile_links(a, b, turned(a, axes), turned(b, axes), threshold)


def _tile_links(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    left, sums, at = None, None, 0
    for cut in (*(c for c in STEPS if c < a.shape[1]), a.shape[1]):
        more = slice(at, cut)
        if left is None:
            dense = pa_[:, more] @ pb[:, more].T
            sums = dense if sums is None else sums + dense
            ra, rb = (np.linalg.norm(p[:, cut:], axis=1) for p in (pa_, pb))
            ok = sums + np.outer(ra, rb) >= threshold - _SLACK
            if cut == a.shape[1] or ok.mean() < 0.2:
                left = np.nonzero(ok)
                sums = sums[left]
        else:
            i, j = left
            sums = sums + np.einsum("ij,ij->i", pa_[i, more], pb[j, more])
            ok = sums + np.linalg.norm(pa_[:, cut:], axis=1)[i] * np.linalg.norm(pb[:, cut:], axis=1)[j] >= threshold - _SLACK
            left, sums = (i[ok], j[ok]), sums[ok]
        at = cut
    i, j = left
    keep = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 16):
        x, y = a[i[s : s + (1 << 16)]], b[j[s : s + (1 << 16)]]
        cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
        keep[s : s + (1 << 16)] = cos >= threshold
    return i[keep], j[keep]


def block_links(a: np.ndarray, b: np.ndarray | None, axes: np.ndarray | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of two blocks, or of one (i < j) if ``b`` is None, tile by tile along the first axis."""
    own = b is None
    sides = []
    for x in (a,) if own else (a, b):
        p = turned(x, axes)
        order = np.argsort(p[:, 0], kind="stable")
        tiles = [order[s : s + TILE] for s in range(0, len(order), TILE)]
        sides.append((x, p, tiles, [(p[t, :LEADING].min(axis=0), p[t, :LEADING].max(axis=0)) for t in tiles]))
    (a, pa_, ta, box_a), (b, pb, tb, box_b) = sides[0], sides[-1]
    reach = 2 - 2 * threshold + _SLACK
    out = [(np.zeros(0, dtype=np.int64),) * 2]
    for m, (ia, (lo1, hi1)) in enumerate(zip(ta, box_a)):
        for k in range(m if own else 0, len(tb)):
            lo2, hi2 = box_b[k]
            gap = np.maximum(0, np.maximum(lo2 - hi1, lo1 - hi2))
            if own and lo2[0] - hi1[0] > reach**0.5:
                break  # tiles further on start further on
            if (gap * gap).sum() > reach:
                continue
            ib = tb[k]
            i, j = _tile_links(a[ia], b[ib], pa_[ia], pb[ib], threshold)
            i, j = ia[i], ib[j]
            if own and k == m:
                i, j = i[i < j], j[i < j]
            out.append((i, j))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _vectors(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = table.column("tile").to_numpy()
        own = table.column("t1")[0].as_py() == table.column("t2")[0].as_py()
        first = tile == table.column("t1")[0].as_py()
        x, cid, n = _vectors(table.column("v").combine_chunks()), table.column("cid").to_numpy(), table.column("n").to_numpy()
        ia = np.flatnonzero(first)
        ib = ia if own else np.flatnonzero(~first)
        if not len(ia) or not len(ib):
            i = j = np.zeros(0, dtype=np.int64)
        else:
            i, j = block_links(x[ia], None if own else x[ib], axes.get(x.shape[1]), threshold)
            i, j = ia[i], ib[j]
        links = np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
        order = np.argsort(cid, kind="stable")
        place = np.argsort(order, kind="stable")
        root = unite(np.arange(len(cid)), place[i], place[j])[place]
        some = links > 0
        return pa.table({"cid": pa.array(cid[some]), "n": pa.array(links[some].astype(np.int64)), "to": pa.array(cid[order][root][some])})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Rows link only where labels are equal and not null. Vectors that are null, empty,
    zero or hold a null or a number that is not finite link with nothing, nor do vectors of
    different lengths. A row without vec_id counts as a partner but has no component.
    Repeated rows each count. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col("embedding")
    rows = vectors.select("vec_id", "label", v.cast("array<double>").alias("embedding"))
    keyed = rows.withColumn("ok", valid(v) & F.col("label").isNotNull())
    keyed = keyed.select("vec_id", "ok", F.xxhash64("label", "embedding").alias("k1"), F.xxhash64(F.lit("2"), "embedding", "label").alias("k2"), "label", "embedding")
    classes = keyed.where("ok").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("embedding").alias("v"))
    classes = scratch.save(classes, "classes")

    axes = {}
    sample = classes.where(F.size("v") <= WIDEST).orderBy("k1", "k2").limit(SAMPLE).select("v").collect()
    for d in {len(r.v) for r in sample}:
        x = np.array([r.v for r in sample if len(r.v) == d], dtype=np.float64)
        axes[d] = axes_of(x / np.linalg.norm(x, axis=1)[:, None])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lead = np.zeros((b.num_rows, LEADING))
            lists = b.column("v")
            size = lists.value_lengths().to_numpy()
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                lead[at, : min(d, LEADING)] = turned(_vectors(lists.take(pa.array(at))), axes.get(int(d)))[:, :LEADING]
            cols = [pa.array(lead[:, k]) for k in range(LEADING)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array(size.astype(np.int32))], names=[*b.schema.names, *leads, "d"])

    leads = [f"x{k}" for k in range(LEADING)]
    schema = T.StructType([*classes.schema, *(T.StructField(c, T.DoubleType()) for c in leads), T.StructField("d", T.IntegerType())])
    total = classes.agg(F.sum(8.0 * F.size("v"))).first()[0] or 0
    # a range partition of the order is a block of bounded bytes, whatever the labels' sizes
    placed = classes.mapInArrow(project, schema).repartitionByRange(max(1, int(-(-total // BLOCK_BYTES))), "label", "d", "x0", "k1")
    cid = F.xxhash64("k1", "k2", "label")
    tiled = scratch.save(placed.select("label", "k1", "k2", cid.alias("cid"), "n", "v", *leads, "d", F.spark_partition_id().alias("tile")), "tiles")
    ends_of = [f(c).alias(f"{name}_{c}") for c in leads for name, f in (("lo", F.min), ("hi", F.max))]
    spans = scratch.save(tiled.groupBy("label", "d", "tile").agg(*ends_of), "spans")
    one, two = spans.alias("a"), spans.alias("b")
    pairs = one.join(two, (F.col("a.label") == F.col("b.label")) & (F.col("a.d") == F.col("b.d")) & (F.col("a.tile") <= F.col("b.tile")))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b.lo_{c}") - F.col(f"a.hi_{c}"), F.col(f"a.lo_{c}") - F.col(f"b.hi_{c}"))
    near = sum((gap(c) * gap(c) for c in leads), F.lit(0.0)) <= 2 - 2 * threshold + _SLACK
    pairs = pairs.where(near).select("a.label", "a.d", F.col("a.tile").alias("t1"), F.col("b.tile").alias("t2"))
    ends = F.when(F.col("t1") == F.col("t2"), F.array("t1")).otherwise(F.array("t1", "t2"))
    wanted = scratch.save(pairs.select("label", "d", "t1", "t2", F.explode(ends).alias("tile")), "pairs")
    both = tiled.select("label", "d", "tile", "cid", "n", "v").join(wanted, ["label", "d", "tile"])
    group = ["label", "d", "t1", "t2"]
    found = scratch.save(both.select(*group, "tile", "cid", "n", "v").groupBy(*group).applyInArrow(_compare(threshold, axes), "cid long, n long, to long"), "links")

    linked = found.groupBy("cid").agg(F.sum("n").alias("others"))
    comp = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")), scratch)
    table = classes.select("label", "k1", "k2", "least", "n", cid.alias("cid")).join(linked, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left")
    table = scratch.save(table.select("label", "k1", "k2", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("root")), "table")
    least = table.groupBy("root").agg(F.min("least").alias("component"))
    of = scratch.save(table.join(least, "root").select(F.col("label").alias("l"), F.col("k1").alias("h1"), F.col("k2").alias("h2"), "n_links", "component"), "of")

    out = keyed.select("vec_id", "ok", "k1", "k2", "label").join(of, F.col("ok") & (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & (F.col("label") == F.col("l")), "left")
    own = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component", "vec_id")).cast("long")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept")
    )


#: The same by DuckDB: all pairs of a label, the components by a recursive walk.
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
w AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT w.x, p.y FROM w JOIN p ON w.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM w GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(c.component_id AS BIGINT) AS component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""
