"""How the sources of a language differ in their words: an audit with exact integers.

Kept terms (those in enough documents of their language) are sorted and built into minimal
acyclic transducers, a run of the order each. All texts are then streamed through these for
a recount: a text starts in the state that its language and a zero byte lead to, so one
transducer serves many languages, and a term comes out as its ordinal. Ordinals ascend with
the UTF-8 of the terms of a language, so they stand for terms from then on and break ties.

Size. Documents are counted inside tasks before they move. A transducer is built of at most
``RUN_BYTES`` of keys as they come in order, and at most ``SENT_BYTES`` of them go to the tasks
at once: a larger vocabulary takes more passes, each over the languages it holds. Sources are
compared over ``BLOCK`` terms of a language and two tiles of ``TILE`` sources at a time, as
dense matrices; only their sums move on. A group's leading terms are limited inside tasks
before the group's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from kvartal.llm.transducer import Transducer
from kvartal.scratch import Scratch

#: Documents of its language that a kept term is in.
LEAST_DOCS = 10
#: Ranks of the part ``term``.
TOP = 10
SCALE = 1_000_000_000
#: Bytes of keys in a transducer, and of transducers that go to the tasks at once.
RUN_BYTES, SENT_BYTES = 1 << 20, 48 << 20
#: Bytes of text looked at together.
SLICE_BYTES = 4 << 20
#: Terms and sources of a matrix.
BLOCK, TILE = 2048, 128

#: A-Z to a-z; other bytes as they are.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes of text, a longer text alone."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes of all texts, start and length of each term, the text that it is in)."""
    binary = texts.cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = _LOWER[data]
    inside = _IN_TERM[data]
    # a term starts where the byte before is not in one, or is of another text
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    start = np.flatnonzero(starts)
    length = np.flatnonzero(ends) + 1 - start
    return data, start, length, np.searchsorted(offsets, start, side="right") - 1


def _document_counts(most: int):
    """(lang, term, documents with it) of each slice of ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, most):
                data, start, length, doc = terms_of(part.column("text"))
                if not len(start):
                    continue
                # terms are all the bytes inside terms, one after another
                off = np.concatenate(([0], np.cumsum(length)))
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data[_IN_TERM[data]])]).dictionary_encode()
                word, k = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
                langs = part.column("lang").dictionary_encode()
                lang = langs.indices.to_numpy().astype(np.int64)
                once = np.unique(doc * k + word)
                pair, n = np.unique(lang[once // k] * k + once % k, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(pair // k)), words.dictionary.take(pa.array(pair % k)).cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "term", "n"]
                )

    return run


def _build(most: int):
    """A transducer of each ``most`` bytes of the keys of a task, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            made = Transducer.build(keys).to_bytes()
            cols = [pa.array([keys[0]], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([len(made)], pa.int64()), pa.array([made], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["first", "n", "size", "made"])

        for batch in batches:
            for key in batch.column("key").to_pylist():
                if keys and size + len(key) > most:
                    yield done()
                    keys, size = [], 0
                keys.append(key)
                size += len(key)
        if keys:
            yield done()

    return run


def key_of(lang: Column, term: Column) -> Column:
    """A language, a zero byte, a term: no term holds a zero byte, so keys of different pairs differ."""
    return F.concat(lang.cast("binary"), F.lit(bytes(1)), term.cast("binary"))


class _Vocabulary:
    """Transducers of consecutive runs of keys, and the ordinals before each."""

    def __init__(self, made: list[tuple[int, bytes]]):
        self.runs = [(base, Transducer.from_bytes(data)) for base, data in made]

    def ordinals(self, texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, ordinal) of every occurrence of a kept term of the text's language."""
        data, start, length, doc = terms_of(texts)
        langs = langs.dictionary_encode()
        lang = langs.indices.to_numpy()[doc]
        found = [(np.zeros(0, np.int64),) * 2]
        for base, run in self.runs:
            leads = [run.lead(x.encode() + b"\0") for x in langs.dictionary.to_pylist()]
            state, before = np.array([s for s, _ in leads], np.int64)[lang], np.array([o for _, o in leads], np.int64)[lang]
            got = run.walk(data, start, length, state, before)
            hit = got >= 0
            found.append((doc[hit], base + got[hit]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _recount(sent, most: int):
    """(lang, source, ord, occurrences) of each slice of ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or _Vocabulary(sent.value)
            for part in _slices(batch, most):
                doc, ordinal = vocabulary.ordinals(part.column("text"), part.column("lang"))
                pairs = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
                groups = pc.dictionary_encode(pc.binary_join_element_wise(pc.cast(pc.binary_length(part.column("lang")), pa.string()), part.column("lang"), part.column("source"), " "))
                group = groups.indices.to_numpy().astype(np.int64)
                if not len(doc):
                    continue
                low, wide = int(ordinal.min()), int(ordinal.max()) - int(ordinal.min()) + 1
                code, n = np.unique(group[doc] * wide + (ordinal - low), return_counts=True)
                _, some = np.unique(group, return_index=True)
                at = pairs.take(pa.array(some[code // wide]))
                yield pa.RecordBatch.from_arrays([at.field(0), at.field(1), pa.array(low + code % wide), pa.array(n.astype(np.int64))], names=["lang", "source", "ord", "n"])

    return run


def _named(sent):
    """(lang, term, ord): the kept terms through the transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or _Vocabulary(sent.value)
            at, ordinal = vocabulary.ordinals(batch.column("text"), batch.column("lang"))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(at), batch.column("text").take(at), pa.array(ordinal)], names=["lang", "term", "ord"])

    return run


def share(n: str | Column, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)) in decimals, as the product can exceed a long."""
    count = F.col(n) if isinstance(n, str) else n
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", over, (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)"))


def _pairs(table: pa.Table) -> pa.Table:
    """Sums over a block's terms of floor((p - q)**2 / (p + q)) for every two sources of two tiles, both ways.

    Rows without an ordinal name the sources; the others hold counts of terms. A term that
    no row of these tiles has counts as often as ``terms`` says, with zero of each.
    """
    head = table.filter(pc.is_null(table["ord"]))
    rest = table.filter(pc.is_valid(table["ord"]))
    ti, tj = head["ti"][0].as_py(), head["tj"][0].as_py()
    names, tile, zero = head["source"].to_pylist(), head["tile"].to_numpy(), head["p"].to_numpy()
    index = {s: k for k, s in enumerate(names)}
    ords, term = np.unique(rest["ord"].to_numpy(), return_inverse=True)
    p = np.tile(zero, (len(ords) + 1, 1))
    if len(ords):
        p[term, [index[s] for s in rest["source"].to_pylist()]] = rest["p"].to_numpy()
    # the last row stands for all terms that neither tile has
    times = np.ones(len(ords) + 1, np.int64)
    times[-1] = head["terms"][0].as_py() - len(ords)
    one, two = np.flatnonzero(tile == ti), np.flatnonzero(tile == tj)
    out: tuple[list, list, list] = ([], [], [])
    for a in one:
        q = p[:, two]
        gap = q - p[:, [a]]
        value = (gap * gap // (q + p[:, [a]]) * times[:, None]).sum(axis=0)
        for b, v in zip(two, value):
            if a != b:
                for x, y in ((a, b),) if ti == tj else ((a, b), (b, a)):
                    out[0].append(names[x])
                    out[1].append(names[y])
                    out[2].append(int(v))
    lang = pa.array([head["lang"][0].as_py()] * len(out[0]), pa.string())
    return pa.table({"lang": lang, "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each source differs from the others of its language, and in which terms.

    Null text, lang and source are empty ones, so a null and an empty source are one group.
    Every row is a document, repeated rows too. Part ``pair`` has each other source of the
    language, with value 0 if no term is kept; part ``term`` at most ``top`` terms that the
    group has more of than its language. Texts without a term, and groups of nothing else,
    count as documents with none. A language of one source has no pairs. Terms of any length
    are kept whole. No rows: no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    text, lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select(text, lang, source)

    seen = rows.select("lang", "text").mapInArrow(_document_counts(SLICE_BYTES), "lang string, term string, n long")
    kept = seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs)
    kept = scratch.save(kept.select("lang", "term", key_of(F.col("lang"), F.col("term")).alias("key")), "kept")
    size = kept.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    ordered = kept.select("key").repartitionByRange(max(1, -(-2 * size // RUN_BYTES)), "key").sortWithinPartitions("key")
    made = scratch.save(ordered.mapInArrow(_build(RUN_BYTES), "first binary, n long, size long, made binary"), "transducers")
    terms = scratch.save(kept.groupBy("lang").agg(F.count("*").alias("terms")), "terms")

    # a line for each transducer, not for each term
    catalogue = made.select("first", "n", "size").orderBy("first").collect()
    counts = names = None
    base = at = 0
    while at < len(catalogue):
        to, sum_ = at + 1, catalogue[at].size
        while to < len(catalogue) and sum_ + catalogue[to].size <= SENT_BYTES:
            sum_, to = sum_ + catalogue[to].size, to + 1
        span = F.col("first") >= F.lit(bytes(catalogue[at].first))
        if to < len(catalogue):
            span &= F.col("first") < F.lit(bytes(catalogue[to].first))
        group = []
        for r in made.where(span).orderBy("first").select("n", "made").toLocalIterator():
            group.append((base, bytes(r.made)))
            base += r.n
        sent = spark.sparkContext.broadcast(group)
        del group
        # keys of a language begin with it and a zero byte
        own = F.concat(F.col("lang").cast("binary"), F.lit(bytes([1]))) >= F.lit(bytes(catalogue[at].first))
        if to < len(catalogue):
            own &= F.concat(F.col("lang").cast("binary"), F.lit(bytes(1))) <= F.lit(bytes(catalogue[to].first))
        part = rows.where(own).select("lang", "source", "text").mapInArrow(_recount(sent, SLICE_BYTES), "lang string, source string, ord long, n long")
        part = scratch.save(part.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "counts")
        name = scratch.save(kept.where(own).select("lang", F.col("term").alias("text")).mapInArrow(_named(sent), "lang string, term string, ord long"), "names")
        counts, names = (part, name) if counts is None else (counts.unionByName(part), names.unionByName(name))
        sent.unpersist()
        at = to
    if counts is None:
        counts = spark.createDataFrame([], "lang string, source string, ord long, n long")
        names = spark.createDataFrame([], "lang string, term string, ord long")

    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("_rows")).select("lang", "source")
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(total, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = scratch.save(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "groups")
    shares = scratch.save(counts.join(groups, ["lang", "source"]).select("lang", "source", "ord", "n", share("n", "total", "terms").alias("p")), "shares")

    # sources against each other
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    tiled = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles"))
    blocks = names.groupBy("lang", F.expr(f"ord div {BLOCK}").alias("block")).agg(F.count("*").alias("terms"))
    heads = tiled.select("lang", "source", "tile", "tiles", F.when(F.col("terms") > 0, share(F.lit(0), "total", "terms")).otherwise(1).alias("p"))
    empty = F.coalesce("block", F.lit(-1)).alias("block"), F.lit(None).cast("long").alias("ord"), F.coalesce("terms", F.lit(0)).alias("terms")
    heads = heads.join(blocks, "lang", "left").select("lang", *empty, "source", "tile", "tiles", "p")
    where = tiled.select("lang", "source", "tile", "tiles")
    body = shares.join(where, ["lang", "source"]).select("lang", F.expr(f"ord div {BLOCK}").alias("block"), "ord", F.lit(0).cast("long").alias("terms"), "source", "tile", "tiles", "p")
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("o")
    both = heads.unionByName(body).select("*", with_)
    units = both.select("lang", "block", F.least("tile", "o").alias("ti"), F.greatest("tile", "o").alias("tj"), "ord", "terms", "source", "tile", "p")
    pairs = units.groupBy("lang", "block", "ti", "tj").applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    # groups against their language
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    of = shares.groupBy("lang", "ord").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "ord", share("n", "total", "terms").alias("q"))
    more = shares.join(of, ["lang", "ord"]).where("p > q").select("lang", "source", "ord", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    rank = F.row_number().over(W.Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ord"))
    lead = scratch.save(more.withColumn("rank", rank).where(F.col("rank") <= top), "lead")
    lead = lead.join(names.select("ord", F.col("term").alias("item")), "ord")
    return pairs.unionByName(lead.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


#: The same by DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (coalesce(n, 0) + 2 * v) AS BIGINT) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (c + 2) // (n + 2 * v) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL) JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY ALL) USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
