"""Language identification by rank-order n-gram profiles.

Cavnar and Trenkle, "N-Gram-Based Text Categorization" (1994): a language's profile is
its most frequent letter n-grams in order; a text gets the language whose profile is
nearest to its own most frequent n-grams by out-of-place distance.

Profiles come from counts over all training rows: each task counts its own batches,
then (lang, n-gram) rows are summed and ranked in Spark. What is shipped to the scoring
tasks is ``PROFILE`` n-grams for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

PROFILE = 400
ORDERS = (1, 2, 3)
#: Code points counted at a time while learning.
CHUNK = 1 << 19

_SHIFT = np.uint64(21)


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and 0 else."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint64, count=0x110000)
    return _TABLE


_TABLE: np.ndarray | None = None


def _points(text: str) -> np.ndarray:
    """Lower-cased code points, each run of others than letters as one 0, with a 0 at both ends."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    x = np.concatenate((np.zeros(1, np.uint64), _letters()[cps], np.zeros(1, np.uint64)))
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
    return x[keep]


def _codes(x: np.ndarray) -> np.ndarray:
    """Codes of all 1- to 3-grams with a letter and without a gap inside."""
    out = []
    for k in ORDERS:
        if len(x) < k:
            continue
        code, ok = np.zeros(len(x) - k + 1, np.uint64), np.zeros(len(x) - k + 1, dtype=bool)
        for j in range(k):
            part = x[j : len(x) - k + 1 + j]
            code = (code << _SHIFT) | part
            ok |= part != 0
        for j in range(1, k - 1):
            ok &= x[j : len(x) - k + 1 + j] != 0
        out.append(code[ok])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def settle(lang: str) -> None:
        if waiting.get(lang):
            totals.setdefault(lang, []).append(np.unique(np.concatenate(waiting[lang]), return_counts=True))
            if len(totals[lang]) > 8:
                codes, inv = np.unique(np.concatenate([c for c, _ in totals[lang]]), return_inverse=True)
                totals[lang] = [(codes, np.bincount(inv, np.concatenate([n for _, n in totals[lang]])).astype(np.int64))]
        waiting[lang], size[lang] = [], 0

    for b in batches:
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text")):
            codes = _codes(_points(t.as_py()))
            waiting.setdefault(lang, []).append(codes)
            size[lang] = size.get(lang, 0) + len(codes)
            if size[lang] > CHUNK:
                settle(lang)
    for lang in list(waiting):
        settle(lang)
        for codes, n in totals.get(lang, []):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """The profile of every non-null lang of the rows that are not held out.

    n-grams are ranked by count, then by code. Languages none of whose training texts
    has a letter get no profile.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), F.col("code"))
    # first the leaders of 32 shares of a language, then the leaders of those
    share = counts.withColumn("s", F.pmod(F.xxhash64("code"), F.lit(32)))
    some = share.withColumn("r", F.row_number().over(W.Window.partitionBy("lang", "s").orderBy(*order))).where(F.col("r") <= PROFILE)
    top = some.withColumn("r", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= PROFILE)
    out: dict[str, list] = {}
    # PROFILE rows a language, one partition at a time
    for r in top.select("lang", "code", "r").toLocalIterator():
        out.setdefault(r.lang, []).append((r.r, r.code))
    return {lang: np.array([c for _, c in sorted(x)], dtype=np.int64).view(np.uint64) for lang, x in sorted(out.items())}


class Scorer:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = list(profiles)
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for k, p in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.grams, p)] = np.arange(len(p))

    def of(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, fit): score is the nearest profile's lead over the next, fit its nearness, both 0 to 1."""
        codes = _codes(_points(text)) if text and self.langs else np.zeros(0, np.uint64)
        if not len(codes):
            return "und", 0.0, 0.0
        codes, n = np.unique(codes, return_counts=True)
        own = codes[np.argsort(-n, kind="stable")[:PROFILE]]
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        r = self.ranks[:, at]
        d = np.where(r < 0, PROFILE, np.abs(r - np.arange(len(own)))).sum(axis=1)
        best = np.argsort(d, kind="stable")
        d1, most = int(d[best[0]]), len(own) * PROFILE
        d2 = int(d[best[1]]) if len(best) > 1 else most
        return self.langs[best[0]], (d2 - d1) / d2 if d2 else 0.0, 1 - d1 / most


NAMES = ("lang_pred", "score", "fit")


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], names: tuple[str, ...] = NAMES) -> DataFrame:
    """Every row of ``docs`` with its language, score and fit, called ``names``, instead of columns of those names.

    A null text and one without a letter are ``und`` with score and fit 0; so is every
    text if nothing was learned. Only the text is looked at, all of it. Other columns come
    through, whatever their names. Ties go to the language that comes first by name.
    """
    used = {n.lower() for n in names}
    rows = docs.select(*(c for c in docs.columns if c.lower() not in used))
    at = [c.lower() for c in rows.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(profiles)
        for b in batches:
            got = [s.of(t.as_py()) for t in b.column(at)]
            cols = [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    made = zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()))
    return rows.mapInArrow(run, T.StructType([*rows.schema, *(T.StructField(n, t) for n, t in made)]))


#: A text whose fit is lower resembles no learned language: letters, but none of its n-grams.
LEAST_FIT = 0.2


def accepted(names: tuple[str, ...] = NAMES) -> F.Column:
    """True for predicted rows that the pipeline keeps."""
    return (F.col(names[0]) != "und") & (F.col(names[2]) >= LEAST_FIT)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    slim = docs.select("doc_id", "lang", "text")
    return predict(slim.select("doc_id", held_out().alias("held_out"), "text"), train(slim)).select("doc_id", "held_out", "lang_pred", "score")
