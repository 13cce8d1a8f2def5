"""Line dedup by a log-template tree.

He et al., "Drain: An Online Log Parsing Approach with Fixed Depth Tree" (2017), as a batch:
a line goes down a tree of fixed depth, first by its number of tokens, then by its LEAD
leading tokens; tokens with a digit are variable fields. In a leaf, two templates link if
they share a run of positions (below), agree in at least SIMILAR of their positions, a field
agreeing with anything, and hold the same fixed token in at least half of them. The run is
part of the rule: without it a field at the end of five tokens would link all of a leaf. Linked ones become one template, whose
differing positions are fields too, until none of a leaf joins another. A template found
in several documents recurs: its lines are dropped from all documents but the first, which
keeps what is said once. Lines of fewer than LEAST_TOKENS tokens, and lines most of whose
tokens hold digits (rows of numbers), are not generalised: only equal ones recur.

Distribution: at d differing positions at most, two lines agree in one of d + 1 runs of
positions, so templates are compared if they share a run (in which a field equals a field
alone), and each joins the least that it links to. Each is compared with the least of its
runs first, in joins; what that one refuses is compared with all others of the run in
tiles of two blocks, so that a run of any size is spread over tasks and none of its links
is missed. Templates do not depend on how lines are dealt to tasks. Texts are read once to
take lines apart; from there on a line is a hash. Only lines of leaves of several are taken
apart into tokens, 32 bits of a hash each: most lines are alone in their leaf.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.names import fresh
from kvartal.scratch import Scratch

LEAD = 3
SIMILAR = 0.8
#: Lines of fewer tokens are not generalised.
LEAST_TOKENS = 5
#: Bytes of a saved table up to which it may be broadcast, and bytes in memory of all that one
#: call of the operator broadcasts; beyond, joins shuffle.
BROADCAST_BYTES, BROADCAST_SUM = 8 << 20, 64 << 20
#: Lines and tokens of a block of a run; a tile compares two blocks.
BLOCK, BLOCK_TOKENS = 512, 1 << 18
#: Lines of one Arrow batch, its bytes a line, and distinct tokens whose hashes a task remembers.
BATCH, WIDTH, MEMO = 1 << 11, 1 << 8, 1 << 15

_digit = re.compile(rb"[0-9]").search
_nines = bytes.maketrans(b"012345678", b"999999999")


class _Tokens(dict):
    """Hash of a token; 0, a field's, if it holds a digit."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[token] = 0 if not token.isalpha() and _digit(token) else xxhash.xxh32_intdigest(token) or 1
        return h


def place(raw: bytes) -> tuple[int, int, bool] | None:
    """(leaf, line, is it generalised?) of a line, None if it is blank."""
    words = raw.split()  # bytes: ASCII space only
    n = len(words)
    if not n:
        return None
    if n >= LEAST_TOKENS:
        fields = 0
        if _digit(raw):
            field = [b"9" in w for w in raw.translate(_nines).split()]
            fields = sum(field)
        if 2 * fields <= n:
            if fields:
                words = [b"\0" if f else w for w, f in zip(words, field)]
            lead = xxhash.xxh64_intdigest(b"%d " % n + b" ".join(words[:LEAD]))
            return lead, xxhash.xxh64_intdigest(b" ".join(words)), True
    line = xxhash.xxh64_intdigest(b" ".join(words), 1)
    return line, line, False


def parse(raw: bytes, known: dict[bytes, int]) -> tuple[int, int, list[int] | None] | None:
    """(leaf, line, tokens) of a line; no tokens if it is not generalised, None if it is blank."""
    at = place(raw)
    return at and (at[0], at[1], list(map(known.__getitem__, raw.split())) if at[2] else None)


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, dtype=np.uint64).view(np.int64))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) -> (doc_id, h, no, leaf, line, raw) of every line that is not blank; raw is null if it is not generalised."""
    for b in batches:
        at, nos, leaves, lines, raws = [], [], [], [], []
        held = 0

        def out() -> pa.RecordBatch:
            of = b.select(["doc_id", "h"]).take(pa.array(at, pa.int64()))
            cols = [pa.array(nos, pa.int32()), _signed(leaves), _signed(lines), pa.array(raws, pa.binary())]
            for x in (at, nos, leaves, lines, raws):
                x.clear()
            return pa.RecordBatch.from_arrays([*of.columns, *cols], names=["doc_id", "h", "no", "leaf", "line", "raw"])

        for row, t in enumerate(b.column("text")):
            text = t.as_buffer().to_pybytes() if t.is_valid else b""
            for no, x in enumerate(text.split(b"\n")):
                got = place(x)
                if got is not None:
                    at.append(row), nos.append(no), leaves.append(got[0]), lines.append(got[1])
                    raws.append(x if got[2] else None)
                    held += len(x)
                    if len(at) >= BATCH or held >= WIDTH * BATCH:
                        yield out()
                        held = 0
        if at:
            yield out()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, line, raw) of generalised lines -> (leaf, line, tokens)."""
    known = _Tokens()
    for b in batches:
        start = 0
        flat, sizes = array("I"), []

        def out() -> pa.RecordBatch:
            ends = pa.array(np.concatenate(([0], np.cumsum(np.array(sizes, dtype=np.int64)))), pa.int32())
            tokens = pa.ListArray.from_arrays(ends, pa.array(np.array(flat, dtype=np.uint32).view(np.int32)))
            return pa.RecordBatch.from_arrays([*b.select(["leaf", "line"]).slice(start, len(sizes)).columns, tokens], names=["leaf", "line", "tokens"])

        for x in b.column("raw"):
            tokens = parse(x.as_buffer().to_pybytes(), known)[2]
            flat.extend(tokens), sizes.append(len(tokens))
            if len(sizes) >= BATCH or len(flat) >= 64 * BATCH:
                yield out()
                start += len(sizes)
                del flat[:], sizes[:]
        if sizes:
            yield out()


class _Scratch(Scratch):
    """Saved tables, and the bytes broadcast so far."""

    sent = 0


def _small(df: DataFrame, scratch: _Scratch) -> DataFrame:
    """``df``, to be broadcast if its rows in memory fit beside what was broadcast before."""
    if scratch.size(df) > BROADCAST_BYTES:
        return df
    items = [F.coalesce(F.sum(F.size(f.name)), F.lit(0)) for f in df.schema if f.dataType.typeName() == "array"]
    rows, *held = df.agg(F.count("*"), *items).first()
    need = rows * (32 + 16 * len(df.columns)) + 4 * sum(held)  # fields and key of a row in a hashed relation
    if scratch.sent + need > BROADCAST_SUM:
        return df
    scratch.sent += need
    return F.broadcast(df)


def _linked(a: Column, b: Column) -> Column:
    """Do two templates of one size agree?"""
    n = F.size(a)
    same = F.zip_with(a, b, lambda x, y: F.when((x == y) & (x != 0), 2).when((x == 0) | (y == 0), 1).otherwise(0))
    fixed = F.aggregate(same, F.lit(0), lambda s, x: s + (x == 2).cast("int"))
    agree = F.aggregate(same, F.lit(0), lambda s, x: s + (x > 0).cast("int"))
    return (agree >= n * F.lit(SIMILAR) - 1e-9) & (fixed * 2 >= n)


def _runs() -> Column:
    """Hashes of a template's runs of positions behind the leading ones, one more than may differ."""
    n = F.size("tokens")
    d = n - F.ceil(n * F.lit(SIMILAR) - 1e-9)
    start = lambda i: (F.lit(LEAD) + F.floor(i * (n - LEAD) / (d + 1))).cast("int")
    return F.transform(F.sequence(F.lit(0).cast("long"), d), lambda i: F.xxhash64("leaf", i, F.slice("tokens", start(i) + 1, start(i + 1) - start(i))))


def _compare(rows: np.ndarray, ids: np.ndarray, refused: np.ndarray, others: np.ndarray, other_ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(index of a refused row, least lesser id that it links to); ``other_ids`` ascend."""
    n = rows.shape[1]
    free = others == 0
    for i in np.flatnonzero(refused):
        m = int(np.searchsorted(other_ids, ids[i]))
        if m:
            a = rows[i]
            same = others[:m] == a
            fixed = (same & (a != 0)).sum(axis=1)
            agree = (same | (a == 0) | free[:m]).sum(axis=1)
            ok = (agree >= n * SIMILAR - 1e-9) & (2 * fixed >= n)
            at = int(ok.argmax())
            if ok[at]:
                yield int(i), int(other_ids[at])


_KEY = ("run", "lo", "hi")


def _tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(leaf, id, to) of one tile's rows, which ascend by id."""
    t = pa.Table.from_batches(parts).combine_chunks()
    leaf, ids, block, refused = (t.column(c).to_numpy() for c in ("leaf", "id", "block", "refused"))
    tokens = pa.concat_arrays([p.column("tokens").flatten() for p in parts]).to_numpy().reshape(len(ids), -1)
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    out: list[tuple[int, int]] = []
    for a, b in [(lo, hi), (hi, lo)] if lo != hi else [(lo, lo)]:
        mine, other = np.flatnonzero(block == a), np.flatnonzero(block == b)
        out += [(int(mine[i]), to) for i, to in _compare(tokens[mine], ids[mine], refused[mine], tokens[other], ids[other])]
    at = np.array([i for i, _ in out], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(leaf[at]), pa.array(ids[at]), pa.array([to for _, to in out], pa.int64())], names=["leaf", "id", "to"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by tile and id -> links of each tile; one tile is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy() for c in _KEY]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            key = tuple(k[i] for k in keys)
            if held and key != last:
                yield _tile(held)
                held = []
            last = key
            held.append(b.slice(i, j - i))
    if held:
        yield _tile(held)


def _refused(near: DataFrame, pairs: DataFrame, links: DataFrame, cur: DataFrame, scratch: _Scratch) -> DataFrame | None:
    """(leaf, id, to) links of templates that the least of a run refuses to others of the run; None if there are none to compare."""
    told = links.select("id", "to", F.lit(False).alias("refused"))
    pairs = pairs.join(told, ["id", "to"], "left").select("id", "to", F.coalesce("refused", F.lit(True)).alias("refused"))
    pairs = scratch.save(pairs, "told")
    heads = scratch.save(pairs.where("refused").select("to").distinct(), "refusing")
    if heads.isEmpty():
        return None
    open_ = near.join(_small(heads, scratch), "to", "left_semi").join(pairs, ["id", "to"])
    members = scratch.save(open_.select("run", "to", "id", "size", "refused"), "members")
    sums = members.groupBy("run", "to").agg(
        F.count("*").alias("n"), F.max("size").alias("size"), F.max("refused").alias("any"), F.min("id").alias("first"), F.max("id").alias("last"), F.bit_xor(F.xxhash64("id")).alias("sig")
    )
    # runs of one head and the same lines are compared once
    runs = sums.where("any and n > 1").groupBy("to", "n", "size", "first", "last", "sig").agg(F.min("run").alias("run"))
    lines = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_TOKENS) / F.col("size"))))
    runs = scratch.save(runs.select("run", F.ceil(F.col("n") / lines).alias("k")), "open")
    dealt = members.join(_small(runs, scratch), "run").select("run", "id", "refused", "k", F.pmod(F.xxhash64("id", F.lit(7)), "k").alias("block"))
    dealt = dealt.select("run", "id", "refused", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("x"))
    dealt = dealt.select("run", F.least("block", "x").alias("lo"), F.greatest("block", "x").alias("hi"), "id", "refused", "block")
    rows = dealt.join(cur, "id").select(*_KEY, "leaf", "id", "refused", "block", "tokens")
    return rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "id").mapInArrow(_tiles, "leaf long, id long, to long")


def templates(distinct: DataFrame, scratch: _Scratch) -> DataFrame:
    """(leaf, line, tokens) distinct lines -> (line, template) of those that end in the template of another line.

    A template is named by the least of its lines.
    """
    cur, of = distinct.withColumnRenamed("line", "id"), None
    while True:
        runs = cur.select("id", F.size("tokens").alias("size"), F.explode(_runs()).alias("run"))
        least = runs.groupBy("run").agg(F.min("id").alias("to"), F.max("id").alias("last")).where("to != last").select("run", "to")
        # written first: beside a fresh aggregate the lines of a run that very many share could not be split
        least = scratch.save(least, "runs")
        near = scratch.save(runs.join(_small(least, scratch), "run").where("id != to").select("run", "id", "to", "size"), "near")
        # tokens come to pairs, not to runs: a long line has as many runs as a fifth of its tokens
        pairs = scratch.save(near.select("id", "to").distinct(), "pairs")
        links = pairs.join(cur, "id").join(cur.select(F.col("id").alias("to"), F.col("tokens").alias("with")), "to").where(_linked(F.col("tokens"), F.col("with")))
        links = scratch.save(links.select("leaf", "id", "to"), "heads")
        others = _refused(near, pairs, links, cur, scratch)
        links = links if others is None else links.union(others)
        # each joins the least that it links to; lesser ones may join others in turn
        joined = scratch.save(links.groupBy("leaf", "id").agg(F.min("to").alias("to")), "links")
        if joined.isEmpty():
            break
        joined = _roots(joined, scratch)
        step = joined.select(F.col("id").alias("line"), F.col("to").alias("template"))
        if of is not None:
            moved = of.join(_small(joined, scratch), F.col("template") == F.col("id"), "left").select("line", F.coalesce("to", "template").alias("template"))
            step = moved.union(step)
        of = scratch.save(step, "templates")
        # leaves without a link have nothing more to join, and lines of no other template are as they were
        open_ = cur.join(joined.select("leaf").distinct(), "leaf", "left_semi")
        own = F.col("to").alias("id")
        new = _small(scratch.save(joined.select("leaf", "id", "to").union(joined.select("leaf", own, "to").distinct()), "members"), scratch)
        members = cur.select("id", "tokens").join(new, "id")
        at = members.select("leaf", "to", F.posexplode("tokens").alias("pos", "t")).groupBy("leaf", "to", "pos").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        token = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0)
        lists = at.groupBy("leaf", "to").agg(F.sort_array(F.collect_list(F.struct("pos", token.alias("t")))).alias("x"))
        lists = lists.select("leaf", F.col("to").alias("id"), F.col("x.t").alias("tokens"))
        cur = scratch.save(open_.join(new.select("id"), "id", "left_anti").select("leaf", "id", "tokens").union(lists), "generalised")
    return of if of is not None else scratch.save(distinct.select("line", F.col("line").alias("template")).limit(0), "templates")


def _roots(joined: DataFrame, scratch: _Scratch) -> DataFrame:
    """(leaf, id, to) with a lesser ``to`` each -> the same, each with the end of its chain."""
    while True:
        up = _small(joined, scratch).select(F.col("id").alias("via"), F.col("to").alias("end"))
        jump = joined.join(up, F.col("to") == F.col("via"), "left").select("leaf", "id", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved"))
        if jump.where("moved").isEmpty():
            return joined
        joined = scratch.save(jump.drop("moved"), "roots")


def recurring(docs: DataFrame, scratch: _Scratch) -> DataFrame:
    """(doc_id, h, drop) the line numbers to drop of every document that has some."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    lines = scratch.save(rows.mapInArrow(_lines, f"doc_id {kind}, h long, no int, leaf long, line long, raw binary"), "lines")
    # only leaves of several lines need their tokens compared
    general = lines.where(F.col("raw").isNotNull())
    many = general.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo != hi").select("leaf")
    many = scratch.save(many, "leaves")
    several = general.join(_small(many, scratch), "leaf", "left_semi").groupBy("leaf", "line").agg(F.any_value("raw").alias("raw"))
    several = several.mapInArrow(_tokens, "leaf long, line long, tokens array<int>")
    of = templates(scratch.save(several, "several"), scratch)
    known = lines.select("doc_id", "h", "no", "line").join(_small(of, scratch), "line", "left").select("doc_id", "h", "no", F.coalesce("template", "line").alias("template"))
    known = scratch.save(known, "known")
    scratch.drop(lines)  # they take as much disk as the texts
    # which templates several documents have is told by hashes; only their lines are looked at again
    who = F.xxhash64("doc_id", "h")
    shared = known.groupBy("template").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo != hi").select("template")
    shared = scratch.save(shared, "shared")
    again = scratch.save(known.join(_small(shared, scratch), "template", "left_semi"), "again")
    doc = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")
    # written first, like the runs
    first = scratch.save(again.groupBy("template").agg(F.min(doc).alias("d")).select("template", F.col("d.doc_id").alias("fd"), F.col("d.h").alias("fh")), "first")
    here = F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh"))
    gone = again.join(_small(first, scratch), "template").where(~here)
    return scratch.save(gone.groupBy("doc_id", "h").agg(F.collect_set("no").alias("drop")), "drop")


def line_dedup(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """Every row and column of ``docs``, the text without its recurring lines, with its number of lines and of dropped ones.

    A line recurs if its template is found in two documents or more; the one with the least
    doc_id (null last; then the least hash of its text) keeps all its lines of that template.
    Blank lines stay. Null texts stay null, empty ones empty, and have 0 and 1 lines. Rows
    equal in doc_id and text are one document and are treated alike. No rows: no rows.
    Columns of the two ``names`` are replaced; all others come through, whatever their names.
    """
    scratch = _Scratch(docs.sparkSession, "lines")
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    d, h, drop, own = fresh([*docs.columns, *names], "d", "h", "drop", "own")
    # one plan at any size: what is dropped grows with the texts, and texts are not sorted
    gone = recurring(docs, scratch).select(F.col("doc_id").alias(d), F.col("h").alias(h), F.col("drop").alias(drop)).hint("shuffle_hash")
    rows = docs.select(*keep, F.xxhash64("text").alias(own)).join(gone, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left")
    all_ = F.split("text", "\n", -1)
    # one sort of the line numbers, so that long texts take no longer a line than short ones
    left = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(drop))
    marks = F.sort_array(F.concat(F.transform(left, lambda i: F.struct(i.alias("i"), F.lit(True).alias("k"))), F.transform(drop, lambda i: F.struct(i.alias("i"), F.lit(False).alias("k")))))
    kept = F.array_join(F.array_compact(F.zip_with(all_, marks, lambda x, m: F.when(m.k, x))), "\n")
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1)
    return rows.select(*(text.alias(c) if c.lower() == "text" else F.col(c) for c in keep), n.cast("long").alias(names[0]), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(names[1]))
