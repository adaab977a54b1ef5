"""Operator 4: stupid-backoff scores from corpus-wide n-gram counts.

Documents are dealt into chunks by hash.  A chunk explodes its texts into
n-grams (orders 0 to ``order``; order 0 is the empty n-gram, whose count is
the number of words) and sends each distinct one once, with its count, to the
bucket that owns its hash: the n-gram count table is partitioned by hash.
The bucket sums the counts of all chunks and joins them back to the n-grams
that were asked for; the chunk sums the scores of each document.  Counts are
combined in the chunk before the shuffle, so a frequent n-gram costs one
entry a chunk, never a group of its own.

A document is scored by the counts of all others: its own are subtracted.
For a word w after the h words before it (at most ``order`` - 1, inside the
document)::

    S(w | h) = c(h w) / c(h)            if c(h w) > 0 and c(h) > 0
             = ALPHA * S(w | h shorter) otherwise
    S(w)     = max(c(w), 0.5) / max(c(), 1)

Words are A-Z lower-cased runs between ASCII blanks, compared by 64-bit hash.

Cases: NULL and blank texts have 0 words, score 0 and NULL mean; rows that
repeat an id are separate documents (copies do see each other's counts); a
NULL id is kept; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hash_exchange as X
from revlens.llm import textspans as S

ORDER = 2
ALPHA = 0.4
ASK = "chunk bigint, bucket bigint, hashes binary, counts binary"
ANSWER = "chunk bigint, bucket bigint, counts binary"
RESULT = "doc_id bigint, n_words bigint, n_backoff bigint, log_score double, mean_log_score double"

#: Keeps n-grams of different orders apart.
_SALT = S.BYTE_VALUES
_EMPTY = _SALT[0]


def _ngrams(table: pa.Table, order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """First word of each document; for each order from 1 the start and hash of
    every n-gram; document of each word."""
    buf, off = S.flat(table["text"])
    st, en = S.word_spans(buf, off, S.NOT_BLANK)
    first = S.per_document(st, off)
    words = np.empty(len(st), dtype=np.uint64)
    for lo, hi in S.chunks(off):
        a, b = first[lo], first[hi]
        words[a:b] = S.span_hashes(buf[off[lo]:off[hi]], st[a:b] - off[lo], en[a:b] - off[lo], S.FOLDED_VALUES)
    n = np.diff(first)
    out = []
    h = words
    for k in range(1, order + 1):
        if k > 1:   # hash of k words from that of k - 1 and the last word
            h = S.mix(h[:-1] * np.uint64(S.WINDOW_BASE) + words[k - 1:]) if len(h) > 1 else np.zeros(0, np.uint64)
        at = S.ranges(first[:-1], np.maximum(n - k + 1, 0))
        out.append((at, h[at] ^ _SALT[k]))
    return first, out, np.repeat(np.arange(len(n)), n)


def _distinct(grams: list[tuple[np.ndarray, np.ndarray]], words: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct hashes of all orders, their counts, and the place of
    each n-gram of each order."""
    every = np.concatenate([h for _, h in grams] + [np.array([_EMPTY])])
    uniq, inv, counts = np.unique(every, return_inverse=True, return_counts=True)
    counts[inv[-1]] = words
    cut = np.cumsum([len(h) for _, h in grams])
    return uniq, counts, np.split(inv[:-1], cut[:-1])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them; the first byte
    is its width."""
    most = int(counts.max()) if len(counts) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _own(doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own document."""
    key = gram.astype(np.uint64) * np.uint64(1 << 32) + doc.astype(np.uint64)
    _, inv, counts = np.unique(key, return_inverse=True, return_counts=True)
    return counts[inv]


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, words scored by backing off, sum and mean
    of the natural logarithms of the scores."""
    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    chunks, buckets = X.sizes(X.text_bytes(d, "text"))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, grams, _ = _ngrams(table, order)
        uniq, counts, _ = _distinct(grams, int(first[-1]))
        rows = list(X.pack(uniq, buckets))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "bucket": pa.array([r[0] for r in rows], pa.int64()),
                         "hashes": pa.array([r[3] for r in rows], pa.binary()),
                         "counts": pa.array([_narrow(counts[lo:hi]) for _, lo, hi, _ in rows], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [X.unpack(key[0].as_py(), x, buckets) for x in table["hashes"].to_pylist()]
        counts = np.concatenate([_wide(x) for x in table["counts"].to_pylist()])
        _, inv = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.zeros(int(inv.max()) + 1, dtype=np.int64)
        np.add.at(total, inv, counts)
        back = total[inv]
        cut = np.cumsum([0] + [len(p) for p in parts])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"],
                         "counts": pa.array([_narrow(back[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())})

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        table = left.combine_chunks()
        first, grams, doc = _ngrams(table, order)
        uniq, _, at = _distinct(grams, int(first[-1]))
        total = np.zeros(len(uniq), dtype=np.float64)
        place = X.places(uniq, buckets)
        for b, counts in zip(right["bucket"].to_pylist(), right["counts"].to_pylist()):
            lo, hi = place[b]
            total[lo:hi] = _wide(counts)
        n = np.diff(first)
        corpus = total[np.searchsorted(uniq, _EMPTY)]
        # counts of each n-gram outside its document, at the word it starts with
        outside = []
        for (start, _), g in zip(grams, at):
            c = np.zeros(len(doc), dtype=np.float64)
            c[start] = total[g] - _own(doc[start], g)
            outside.append(c)
        size = np.maximum(corpus - n[doc], 1)
        logs = np.log(np.maximum(outside[0], 0.5) / size) if len(doc) else np.zeros(0)
        place_in_doc = np.arange(len(doc)) - first[:-1][doc]
        direct = np.ones(len(doc), dtype=bool)
        for k in range(2, order + 1):
            ends = np.flatnonzero(place_in_doc >= k - 1)
            whole, before = outside[k - 1][ends - k + 1], outside[k - 2][ends - k + 1]
            seen = (whole > 0) & (before > 0)
            logs[ends] = np.where(seen, np.log(np.where(seen, whole, 1) / np.where(seen, before, 1)),
                                  math.log(alpha) + logs[ends])
            direct[ends] = seen
        total_log = np.array([logs[a:b].sum() for a, b in zip(first[:-1], first[1:])], dtype=np.float64)
        backed = np.concatenate([[0], np.cumsum(~direct)])
        mean = np.divide(total_log, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()),
                         "n_backoff": pa.array(backed[first[1:]] - backed[first[:-1]], pa.int64()),
                         "log_score": pa.array(total_log), "mean_log_score": pa.array(mean, mask=n == 0)})

    asked = d.groupBy("chunk").applyInArrow(ask, ASK)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWER)
    return d.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(add, RESULT)


def brute_force(rows: list[tuple], order: int = ORDER, alpha: float = ALPHA) -> list[tuple]:
    """Plain rendering of the definition for small inputs."""
    texts = [(i, (t or "").encode().lower().split()) for i, t in rows]
    grams = lambda w: Counter(tuple(w[j:j + k]) for k in range(1, order + 1) for j in range(len(w) - k + 1))
    corpus, words = Counter(), 0
    for _, w in texts:
        corpus.update(grams(w))
        words += len(w)
    out = []
    for i, w in texts:
        own = grams(w)
        c = lambda g: corpus[g] - own[g]
        total, backed = 0.0, 0
        for j in range(len(w)):
            value = math.log(max(c((w[j],)), 0.5) / max(words - len(w), 1))
            seen = True
            for k in range(2, min(order, j + 1) + 1):
                g = tuple(w[j - k + 1:j + 1])
                seen = c(g) > 0 and c(g[:-1]) > 0
                value = math.log(c(g) / c(g[:-1])) if seen else math.log(alpha) + value
            total += value
            backed += not seen
        out.append((i, len(w), backed, total, total / len(w) if w else None))
    return out
