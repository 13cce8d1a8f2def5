"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A unigram model scores a segmentation by the sum of its pieces' log probabilities.
The best forward score of a prefix does not depend on what follows it, so all distinct
pre-tokens of a batch go into one trie and each shared prefix is scored once; a
pre-token's count is stored at its terminal node. The trie is walked as the sorted
list of pre-tokens: the next one keeps the scores of the prefix it shares with the last.

Pieces and their order come from a public vocabulary file of base64 pieces and ranks
(its path is a parameter). With no probabilities in such a file, the rank gives them:
log p(rank) = -log(rank + ZIPF), Zipf's law. Every byte is a piece, so every text has
a segmentation; ties take fewer tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text falls into pre-tokens: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ZIPF = 2.7
#: Distinct pre-tokens whose counts a task remembers, and bytes of those that it remembers at all.
MEMO, MEMO_BYTES = 1 << 18, 64


def load(path: str = VOCABULARY) -> dict[bytes, float]:
    """Pieces with their log probabilities. The file is read on the driver only."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return {piece: -math.log(rank + ZIPF) for piece, rank in ranks.items()}


class Trie:
    """Forward scores of sorted pre-tokens; the path from the root to the last one is kept."""

    def __init__(self, ends: dict[bytes, float]):
        self.ends = ends
        self.path = b""
        self.best: list[tuple[float, int]] = [(0.0, 0)]  # by depth: (score, minus tokens)

    def count(self, token: bytes) -> int:
        shared, most = 0, min(len(self.path), len(token))
        while shared < most and self.path[shared] == token[shared]:
            shared += 1
        del self.best[shared + 1 :]
        best, get = self.best, self.ends.get
        for end in range(shared + 1, len(token) + 1):
            top, fewest = -math.inf, 0
            for start in range(end - 1, -1, -1):
                p = get(token[start:end])
                if p is None:  # no piece ends so: none that starts further left does
                    break
                s, n = best[start]
                s += p
                if s > top or s == top and n - 1 > fewest:
                    top, fewest = s, n - 1
            best.append((top, fewest))
        self.path = token
        return -best[len(token)][1]


def endings(pieces: dict[bytes, float]) -> dict[bytes, float]:
    """Every ending of a piece, with the log probability of those that are pieces and -inf for the others."""
    out = {p[i:]: -math.inf for p in pieces for i in range(1, len(p))}
    out.update(pieces)
    return out


def count_distinct(tokens: set[str], ends: dict[bytes, float]) -> dict[str, int]:
    """Tokens of each distinct pre-token, by one walk of their trie."""
    trie = Trie(ends)
    return {t: trie.count(raw) for raw, t in sorted((t.encode("utf-8", "surrogatepass"), t) for t in tokens)}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_bytes of every row; null and empty texts have 0 of each.

    Needs no shuffle: each task counts the distinct pre-tokens of its batches and
    remembers up to MEMO short ones. The vocabulary is of fixed size and travels with the code.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(load(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, find, known = endings(shipped.value), regex.compile(PATTERN).findall, {}
        for b in batches:
            sums: list[list[int]] = [[], [], []]
            ids = b.column("doc_id")
            for at in range(0, b.num_rows, 256):
                split = [find(t.as_py() or "") for t in b.column("text").slice(at, 256)]
                new = set().union(*split).difference(known)
                known.update(count_distinct(new, ends))
                for s in split:
                    sums[0].append(len(s))
                    sums[1].append(sum(map(known.__getitem__, s)))
                for t in new:
                    if len(t) > MEMO_BYTES:
                        del known[t]
                if len(known) > MEMO:
                    known.clear()
            sums[2] = [len((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in sums)], names=["doc_id", "n_pretokens", "n_tokens", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, n_bytes long")
