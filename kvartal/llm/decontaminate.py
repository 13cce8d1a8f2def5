"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A window of an item (``WINDOW`` consecutive words, or the whole of a shorter item) occurs in
a document only if its rarest word does. So words are ordered by how often the corpus holds
them, and each window joins the documents on that one necessary word: its prefix for an
overlap of all words. Windows of an item that share the same rarest occurrence become one
anchor that carries the up to WINDOW - 1 item words on either side. A document word that
equals an anchor is a candidate alignment; position and length bound how far it can reach,
and the words around it are compared with the item's until they differ. The equal run is
exactly the union of the windows that occur there, if it is at least one window long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.names import fresh
from kvartal.scratch import Scratch

NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
WINDOW = 13
#: Bytes of a saved table up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20
#: A document with hits is contaminated if the hit words are at least one in so many.
SHARE = 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)  # then lower() touches A-Z only, and is faster
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.coalesce(F.array_remove(F.split(low, _BETWEEN, -1), ""), F.array().cast("array<string>"))


def _maybe_broadcast(df: DataFrame, scratch: Scratch) -> DataFrame:
    return F.broadcast(df) if scratch.size(df) <= BROADCAST_BYTES else df


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long")).cast("int")


def _anchors(items: DataFrame, counts: DataFrame, scratch: Scratch, window: int) -> tuple[DataFrame, DataFrame]:
    """(cid, word, before, after, need) distinct anchors, and (cid, item_id) of those with an id.

    ``before`` runs leftwards from the anchor, ``after`` rightwards.
    """
    size = F.size("iw")
    starts = items.select("row", "iw", F.least(size, F.lit(window)).alias("need"), F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))).alias("s"))
    each = starts.select("row", "s", F.posexplode(F.slice("iw", F.col("s") + 1, F.col("need"))).alias("o", "word")).withColumn("at", F.col("s") + F.col("o"))
    rare = each.join(counts, "word", "left").groupBy("row", "s").agg(F.min_by("at", F.struct(F.coalesce("n", F.lit(0)), "word", "at")).alias("at"))
    at = F.col("at")
    spots = rare.select("row", "at").distinct().join(items, "row").select(
        "item_id",
        F.element_at("iw", at + 1).alias("word"),
        F.reverse(F.slice("iw", F.greatest(at - (window - 1), F.lit(0)) + 1, F.least(at, F.lit(window - 1)))).alias("before"),
        F.slice("iw", at + 2, F.lit(window - 1)).alias("after"),
        F.least(size, F.lit(window)).alias("need"),
    )
    spots = scratch.save(spots, "spots")
    key = ["word", "before", "after", "need"]
    anchors = scratch.save(spots.select(*key).distinct().withColumn("cid", F.monotonically_increasing_id()), "anchors")
    named = scratch.save(spots.where(F.col("item_id").isNotNull()).join(anchors, key).select("cid", F.col("item_id").cast("string").alias("item")).distinct(), "items")
    return anchors, named


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, whole_rows: bool = False, names: tuple[str, ...] = NAMES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (the last five called ``names``) of every row of ``docs``.

    With ``whole_rows`` all columns of ``docs`` come along, other than those five.

    Null and wordless texts have no words and no hits; wordless items have no window. An
    item whose item_id is null hits words but is neither counted nor named; items that
    share an id count once. Repeated rows each get their row, rows that share a doc_id
    are told apart by their texts, and other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("iw")).where(F.size("iw") > 0)
    items = scratch.save(items.withColumn("row", F.monotonically_increasing_id()), "benchmark")
    vocabulary = scratch.save(items.select(F.explode("iw").alias("word")).distinct(), "vocabulary")
    tokenised = docs.select(F.col("doc_id"), F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    # outer: an inner explode is given a filter on its array, which would tokenise every text twice
    seen = tokenised.select(F.explode_outer("words").alias("word")).join(_maybe_broadcast(vocabulary, scratch), "word")
    counts = scratch.save(seen.groupBy("word").agg(F.count("*").alias("n")), "counts")
    anchors, named = _anchors(items, counts, scratch, window)

    reach = window - 1
    pos = F.col("pos")
    spread = tokenised.select("doc_id", "h", "words", F.posexplode_outer("words").alias("pos", "word")).select(
        "doc_id", "h", "word", "pos",
        F.slice("words", F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach))).alias("left"),
        F.slice("words", pos + 2, F.lit(reach)).alias("right"),
    )
    # length bound: an alignment cannot hold more words than either text has around the anchor
    room = F.least(F.size("left"), F.size("before")) + 1 + F.least(F.size("right"), F.size("after")) >= F.col("need")
    near = spread.join(_maybe_broadcast(anchors, scratch), "word").where(room)
    back, ahead = _run(F.reverse("left"), F.col("before")), _run(F.col("right"), F.col("after"))
    found = near.select("doc_id", "h", "cid", "need", F.explode(F.array(F.struct((pos - back).alias("start"), (pos + ahead + 1).alias("end")))).alias("run"))
    hits = found.where(F.col("run.end") - F.col("run.start") >= F.col("need")).select("doc_id", "h", "cid", "run")
    hits = scratch.save(hits, "hits")

    key = ["doc_id", "h"]
    # words inside the union of the runs: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("far"), F.lit(0).cast("long").alias("n")),
        lambda a, r: F.struct(F.greatest(a.far, r.end).alias("far"), (a.n + F.greatest(r.end - F.greatest(a.far, r.start), F.lit(0))).alias("n")),
        lambda a: a.n,
    )
    runs = hits.groupBy(*key).agg(F.collect_set("run").alias("runs")).select(*key, covered.alias("n_hit"))
    of = hits.select(*key, "cid").distinct().join(_maybe_broadcast(named, scratch), "cid").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("ids"))
    per = runs.join(of, [runs.doc_id.eqNullSafe(of.doc_id), runs.h == of.h], "left").select(runs.doc_id, runs.h, "n_hit", "ids")
    per = scratch.save(per, "documents")

    # the per-document table is small where few are hit; then no row of the corpus moves
    n_words, n_hit, n_items, digest, contaminated = names
    used = {n.lower() for n in names}
    keep = [c for c in docs.columns if c.lower() not in used] if whole_rows else ["doc_id"]
    h, d, g, hits_, ids_ = fresh([*keep, *names], "h", "d", "g", "hit", "ids")
    rows = docs.select(*keep, F.xxhash64("text").alias(h), F.size(words_of(F.col("text"))).cast("long").alias(n_words))
    hit = _maybe_broadcast(per, scratch).select(F.col("doc_id").alias(d), F.col("h").alias(g), F.col("n_hit").alias(hits_), F.col("ids").alias(ids_))
    out = rows.join(hit, [F.col("doc_id").eqNullSafe(F.col(d)), F.col(h) == F.col(g)], "left")
    ids = F.coalesce(F.col(ids_), F.array().cast("array<string>"))
    n = F.coalesce(F.col(hits_), F.lit(0)).cast("long")
    return out.select(
        *keep,
        n_words,
        n.alias(n_hit),
        F.size(ids).cast("long").alias(n_items),
        F.sha2(F.array_join(ids, ","), 256).alias(digest),
        ((n > 0) & (SHARE * n >= F.col(n_words))).alias(contaminated),
    )


#: The same by DuckDB, by listing every window of every document.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, len, array_to_string(w[s:s + len - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 13) AS len, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM iw),
dw AS (SELECT doc_id, s, lens.len AS len, array_to_string(w[s:s + lens.len - 1], ' ') AS win
       FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d) x, lens WHERE s + lens.len - 1 <= len(w)),
hit AS (SELECT DISTINCT dw.doc_id, dw.s, dw.len, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.len = iw.len),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + len)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
