"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

McMahan et al., "Ad Click Prediction: a View from the Trenches" (2013): per-coordinate
learning rates and an L1 term that keeps most weights at zero, so that what is shipped
to the scoring tasks is a short list of (index, weight).

The model is fitted on a bounded sample of the labelled rows (``SAMPLE`` of them, the
least by a hash of their doc_id) in one task; every whole text is then scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000
BITS = 20
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 1.0
THRESHOLD = 0.3
#: Distinct words whose hashes a scoring worker remembers.
MEMO = 1 << 18

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_A, _B, _M = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


class _Hashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[w] = zlib.crc32(w)
        return h


_memo = _Hashes()


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _M
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct indices of the text's words, word pairs and pairs that skip one word.

    Index 0 is the intercept and belongs to every text, an empty or null one too.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    h = np.fromiter(map(_memo.__getitem__, words), dtype=np.uint32, count=len(words))
    parts = [_mix(h, bits), _mix(h[:-1] * _A + h[1:], bits), _mix(h[:-2] * _B + h[2:], bits)]
    return np.unique(np.concatenate([np.zeros(1, dtype=np.uint32), *parts]))


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) other than zero after EPOCHS passes over the rows in their order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(zi) <= L1] = 0.0
        return w

    for _ in range(EPOCHS):
        for i, y in rows:
            w = weights(i)
            g = _sigmoid(w.sum()) - y
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(1 << bits))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        for o, t, y in zip(b.column("o").to_pylist(), b.column("text"), b.column("toxic").to_pylist()):
            rows.append((o, features(t.as_py()), y))
    if rows:
        rows.sort(key=lambda r: r[0])
        at, w = fit([r[1:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], names=["i", "w"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most about ``sample`` labelled rows that are not held out.

    Rows with a null doc_id or label teach nothing. Of repeated labels of a document the
    larger one counts. No labelled row at all: no weights, so that every score is 0.5.
    """
    y = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    y = y.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = y.count()
    # a share of the rows by hash, so that each task picks its own
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    share = int(min(1.0, sample / max(n, 1)) * (1 << 31))
    picked = y.where(F.pmod(order, F.lit(1 << 31)) < share)
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select(order.alias("o"), "text", "toxic")
    got = rows.repartition(1).mapInArrow(_fit, "i long, w double").collect()
    return np.array([r.i for r in got], dtype=np.int64), np.array([r.w for r in got])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null text scores as an empty one."""
    at, w = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        dense[at] = w
        for b in batches:
            s = pa.array([_sigmoid(dense[features(t.as_py(), bits)].sum()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), s], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, then score every row of ``docs``."""
    return score(docs, train(docs, labels))
