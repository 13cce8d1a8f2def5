"""Personal data by weak supervision, in DataFrame operations only.

Base spans (email, ip, card, phone) come from four patterns with a validity test each.
Further candidates are what the base drops (a card number without a valid check digit,
an address with a part over 255, a phone number of odd length), phone numbers without a
plus, and long tokens of letters and digits. Labelers vote on every candidate:

* pattern: its shape is one of that kind, or of another thing (a version, a date);
* validity: check digit, number range, number of digits;
* gazetteer: issuer digits, telephone code 555-style exchange, top-level domain;
* context: words before it that name personal data, or a thing that is none.

Candidates with equal votes and features are counted in Spark; expectation-maximisation
over that bounded table (Dawid and Skene, 1979) estimates how reliable each labeler is
and how likely each pattern of votes is personal data. A logistic regression on votes and
features is then fitted to those probabilities, and its decisions add spans. Base spans stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kvartal.scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "secret")
#: Possessive groups do not recurse, so texts of any length are matched; nothing follows them, so they match alike.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+",
}
LOOSE_PHONE = r"(?<![0-9+] ?)\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
#: Code points before a span that the context labeler sees.
CONTEXT = 24
#: A model decides to add a span from this probability on.
ADD = 0.5
#: Share of candidates that are personal at first, and how many made-up candidates hold it there, as a share of all.
PRIOR, HOLD = 0.3, 0.1
EM_ROUNDS, NEWTON_ROUNDS = 50, 20
#: How far a labeler's votes are believed at most, in the order of VOTES: a check digit is arithmetic, a shape is a guess.
SURE = (0.95, 0.995, 0.95, 0.95)
VOTES = ("v_pattern", "v_valid", "v_gazetteer", "v_context")
FEATURES = ("f_kind", "f_length", "f_digits")

_PERSONAL = r"(?i)(token|secret|key|passw|pwd|card|visa|pan|iban|account|acct|phone|tel|call|mobile|fax|mail|contact|ip|addr|host|login|user)[^A-Za-z]{0,6}$"
_OTHER = r"(?i)(version|license|licence|isbn|issn|section|page|pages|chapter|figure|table|v)[^A-Za-z0-9]{0,3}$"


def _pieces(text: Column, pattern: str, source: int, may: Column) -> Column:
    """All leftmost matches that do not overlap, in order: number i, code points before it, the last of those, the match; none unless ``may``."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.zip_with(between, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("tail"), m.alias("m")))
    rows = F.transform(pieces, lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("i"), x.gap.alias("gap"), x.tail.alias("tail"), x.m.alias("m")))
    return F.when(may, F.filter(rows, lambda x: x.m.isNotNull())).otherwise(F.array().cast("array<struct<source:int,i:int,gap:int,tail:string,m:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, d * 2).otherwise(d)
        return a + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.lit(kind == "email")


def spans(docs: DataFrame) -> DataFrame:
    """Candidates of every row: doc_id, h, kind number k, s, e, m, before (the context), base (a valid base span).

    ``h`` is a hash of the text, which tells apart rows that share a doc_id. Only matches
    leave their row; where they stand is a running sum over the matches of a pattern, so
    that a text of very many matches takes no longer a match than others.
    """
    text = F.col("text")
    digit = text.rlike("[0-9]")
    may = {"email": F.contains(text, F.lit("@")), "ip": digit & F.contains(text, F.lit(".")), "card": digit, "phone": F.contains(text, F.lit("+")), "secret": digit}
    found = [_pieces(text, PATTERNS[k], i, may[k]) for i, k in enumerate(KINDS)] + [_pieces(text, LOOSE_PHONE, len(KINDS), F.contains(text, F.lit("(")))]
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    # outer: an inner explode is given a filter on its array, which would search every text twice
    each = rows.select("doc_id", "h", "row", F.explode_outer(F.concat(*found)).alias("x")).where(F.col("x").isNotNull()).select("doc_id", "h", "row", "x.*")
    order = Window.partitionBy("row", "source").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    before = F.right(F.concat(F.coalesce(F.lag("m").over(order), F.lit("")), "tail"), F.lit(CONTEXT))
    placed = each.select("doc_id", "h", "source", "m", before.alias("before"), (end - F.length("m")).alias("s"), end.alias("e"))
    base = F.lit(False)
    for i, k in enumerate(KINDS[:4]):
        base = F.when(F.col("source") == i, valid(k, F.col("m"))).otherwise(base)
    kind = F.when(F.col("source") == len(KINDS), KINDS.index("phone")).otherwise(F.col("source"))
    return placed.select("doc_id", "h", kind.alias("k"), "s", "e", "m", "before", base.alias("base"))


def votes(cands: DataFrame) -> DataFrame:
    """Candidates with the labelers' votes (1 personal, 0 not, -1 abstains) and features."""
    k, m, d = F.col("k"), F.col("m"), _digits(F.col("m"))
    kind = lambda name: k == KINDS.index(name)
    n, nd = F.length(m), F.length(d)
    mixed = m.rlike("[A-Za-z]") & m.rlike("[0-9]")
    turns = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    pattern = (
        F.when(kind("secret"), F.when(mixed & (n >= 20) & (turns >= 3), 1).otherwise(0))
        .when(kind("card"), F.when(nd.between(15, 19), 1).otherwise(0))
        .when(kind("ip"), F.when(nd >= 13, -1).otherwise(0))
        .when(kind("phone"), F.when(nd.between(7, 15), 1).otherwise(0))
        .otherwise(1)
    )
    checked = F.when(kind("secret"), F.lit(-1)).when(F.col("base"), 1).otherwise(F.when(kind("card") & nd.between(16, 19), -1).otherwise(0))
    gazetteer = (
        F.when(kind("card"), F.when((nd >= 13) & d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1))
        .when(kind("phone"), F.when(m.rlike(r"\([0-9]{3}\)"), 1).otherwise(-1))
        .when(kind("email"), F.when(m.rlike(r"(?i)\.(com|net|org|edu|gov|io|de|fr|es|uk)$"), 1).otherwise(-1))
        .when(kind("secret"), F.when(m.rlike("^[0-9a-f]+$|^(sk|pk|AKIA|gh[pousr])_?"), 1).otherwise(-1))
        .otherwise(-1)
    )
    before = F.col("before")
    context = F.when(before.rlike(_PERSONAL), 1).when(before.rlike(_OTHER), 0).otherwise(-1)
    return cands.withColumns(
        {
            "v_pattern": pattern.cast("int"), "v_valid": checked.cast("int"), "v_gazetteer": gazetteer.cast("int"), "v_context": context.cast("int"), "f_kind": k,
            "f_length": F.when(n < 12, 0).when(n < 20, 1).otherwise(2), "f_digits": F.when(nd * 2 < n, 0).when(nd < n, 1).otherwise(2),
        }
    )


@dataclass
class Model:
    """Reliabilities of labelers, and the span classifier's weight for each value of a vote or feature."""

    reliable: dict[str, tuple[float, float]]
    bias: float
    weights: dict[tuple[str, int], float]

    def score(self) -> Column:
        z = F.lit(self.bias)
        for name in (*VOTES, *FEATURES):
            cases = None
            for (n, value), w in self.weights.items():
                if n == name:
                    cases = (F if cases is None else cases).when(F.col(name) == value, F.lit(float(w)))
            if cases is not None:
                z = z + cases.otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fit(patterns: list[tuple], names: tuple[str, ...] = (*VOTES, *FEATURES)) -> Model:
    """EM over distinct vote patterns with their counts, then logistic regression on its probabilities."""
    if not patterns:
        return Model({v: (0.5, 0.5) for v in VOTES}, -1.0, {})
    table = np.array([p[:-1] for p in patterns], dtype=np.int64)
    count = np.array([p[-1] for p in patterns], dtype=np.float64)
    vote = table[:, : len(VOTES)]
    said = vote >= 0
    # at first a labeler is right four times in five
    prior, hit, miss = PRIOR, np.full(len(VOTES), 0.8), np.full(len(VOTES), 0.2)
    p = np.full(len(table), 0.5)
    for _ in range(EM_ROUNDS):
        yes = np.log(prior) + (said * np.where(vote == 1, np.log(hit), np.log(1 - hit))).sum(axis=1)
        no = np.log(1 - prior) + (said * np.where(vote == 1, np.log(miss), np.log(1 - miss))).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        prior = ((count * p).sum() + PRIOR * HOLD * count.sum()) / ((1 + HOLD) * count.sum())
        w1, w0 = (count * p)[:, None] * said, (count * (1 - p))[:, None] * said
        # a few made-up votes keep labelers that seldom speak near their first rates
        hit = np.clip(((w1 * (vote == 1)).sum(axis=0) + 8) / (w1.sum(axis=0) + 10), 0.5, SURE)
        miss = np.clip(((w0 * (vote == 1)).sum(axis=0) + 2) / (w0.sum(axis=0) + 10), 1 - np.array(SURE), 0.5)
    keys = sorted({(n, int(v)) for row in table for n, v in zip(names, row)})
    at = {k: i for i, k in enumerate(keys)}
    x = np.zeros((len(table), len(keys)))
    for r, row in enumerate(table):
        for n, v in zip(names, row):
            x[r, at[n, int(v)]] = 1
    x = np.hstack([x, np.ones((len(table), 1))])
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(NEWTON_ROUNDS):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (count * np.maximum(q * (1 - q), 1e-6))[:, None]
        w -= np.linalg.solve(x.T @ (curve * x) + ridge, x.T @ (count * (q - p)) + ridge @ w)
    b = w[-1]
    return Model(dict(zip(VOTES, zip(hit.tolist(), miss.tolist()))), float(b), dict(zip(keys, w.tolist())))


def _gives_way() -> Column:
    """An added span gives way to base spans and to added ones of an earlier kind that it overlaps, by one pass from either end."""
    up = Window.partitionBy("doc_id", "h").orderBy("s").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("doc_id", "h").orderBy(F.col("s").desc()).rangeBetween(Window.unboundedPreceding, 0)

    def meets(other: Column) -> Column:
        # of those that start no later the furthest end, of those that start no earlier the first start
        return F.coalesce(F.max(F.when(other, F.col("e"))).over(up) > F.col("s"), F.lit(False)) | F.coalesce(F.min(F.when(other, F.col("s"))).over(down) < F.col("e"), F.lit(False))

    out = meets(F.col("base"))
    for i in range(len(KINDS) - 1):
        out = out | ((F.col("k") > i) & meets(~F.col("base") & (F.col("k") == i)))
    return ~F.col("base") & out


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret of every row of ``docs``.

    Null texts are empty: no spans, and the digest of an empty string. Repeated rows each
    get their row; other columns are not looked at. Without candidates nothing is added.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    cands = scratch.save(votes(spans(docs)), "candidates")
    table = cands.groupBy(*VOTES, *FEATURES).count().collect()  # at most 3 ** 4 * 5 * 3 * 3 rows
    model = fit(sorted(tuple(r) for r in table))
    key = ["doc_id", "h"]
    told = cands.select(*key, "k", "s", "e", "base", (F.col("base") | (model.score() >= ADD)).alias("on")).where("on")
    struct = F.struct("k", "s", "e")
    per = told.withColumn("off", _gives_way()).where("not off").groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("base"), struct))).alias("base"), F.array_sort(F.collect_set(struct)).alias("all"))
    per = scratch.save(per.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "base", "all"), "documents")

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"))
    out = rows.join(per, [F.col("doc_id").eqNullSafe(F.col("d")), F.col("h") == F.col("g")], "left")
    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s, x.e)), ",")
    count = lambda c, kind: F.coalesce(F.size(F.filter(c, lambda x: x.k == KINDS.index(kind))), F.lit(0)).cast("long").alias(f"n_{kind}")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    base, all_ = F.coalesce("base", none), F.coalesce("all", none)
    return out.select("doc_id", *(count(base, k) for k in KINDS[:4]), F.sha2(shown(base), 256).alias("base_sha256"), shown(all_).alias("spans"), count(all_, "secret"))
