"""Operator 3: language identification as multilingual mixture inference.

Training counts the byte trigrams of the words (padded by blanks, A-Z
lower-cased, hashed to ``BUCKETS``) of every labelled document that is not
held out, one count table a language, summed by Spark.  The model has
languages x BUCKETS numbers; more than ``LANGUAGES_MOST`` languages raise an
error, so what the driver gathers and the tasks receive is bounded.

For a document, each word has a likelihood under each language; expectation
maximisation estimates the language proportions.  The set of languages is
chosen by penalised likelihood: mixtures of the first 1, 2 .. ``SET_MOST``
languages by share are fitted, and each further language must gain more than
``PENALTY`` x log(words).

A row is held out if crc32(doc_id as text) mod 5 is 0 (a NULL id is not).

Cases: NULL text or text without a letter: ``und``, score 0; NULL lang: not
learned from; no labelled rows: ``und`` for all; ties between languages go to
the first name; repeated rows give equal rows; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import textspans as S

BUCKETS = 1 << 16
MODEL_MOST = 1 << 24
#: Count tables a task holds before it sends them on (half a megabyte each).
TABLES_HELD = 256
PENALTY = 3.0
ROUNDS = 10
SMOOTHING = 0.5
FOLDS, HELD = 5, 0
SCHEMA = ("doc_id bigint, held_out boolean, lang_pred string, score double, "
          "languages array<struct<lang:string,share:double>>")

LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (start, end), word numbers, and first word of each text."""
    st, en = S.word_spans(buf, off, LETTERS)
    at, inv = S.distinct_spans(S.FOLD[buf], st, en)
    return st[at], en[at], inv, S.per_document(st, off)


def _trigrams(buf: np.ndarray, st: np.ndarray, en: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of padded words, and the first of each word."""
    size = en - st + 2
    first = np.concatenate([[0], np.cumsum(size)])
    text = np.full(first[-1] + 2, 0x20, dtype=np.uint8)
    inside = S.ranges(first[:-1] + 1, en - st)
    b = buf[S.ranges(st, en - st)]
    text[inside] = np.where((b >= 65) & (b <= 90), b + 32, b)
    n = en - st                                   # a word of n bytes has n trigrams
    at = S.ranges(first[:-1], n)
    code = (text[at].astype(np.uint64) << np.uint64(16)) | (text[at + 1].astype(np.uint64) << np.uint64(8)) | text[at + 2]
    return ((code * np.uint64(S.BASE)) >> np.uint64(48)).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and log-probabilities, BUCKETS x languages."""
    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), docs[id_col].alias("id")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("id"), FOLDS) != HELD, F.lit(True)))

    def tables_of(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                  names=["lang", "bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                if len(sums) >= TABLES_HELD and lang not in sums:
                    yield from tables_of(sums)
                    sums.clear()
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                buf, off = S.flat(b.column(1).filter(pa.array(langs == lang)))
                for lo, hi in S.chunks(off):
                    part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                    st, en, inv, _ = _words(part, o)
                    if len(st):
                        gram, first = _trigrams(part, st, en)
                        weight = np.bincount(inv, minlength=len(st))
                        total += np.bincount(gram, np.repeat(weight, np.diff(first)), BUCKETS).astype(np.int64)
        yield from tables_of(sums)

    n_langs = rows.agg(F.count_distinct("lang")).first()[0]
    shift = 0
    while shift < 16 and n_langs * (BUCKETS >> shift) > MODEL_MOST:
        shift += 1
    counted = (rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint")
               .groupBy("lang", F.shiftright("bucket", shift).alias("bucket")).agg(F.sum("n").alias("n")))
    got = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    tables = {}
    for r in got.toLocalIterator():
        tables[r["lang"]] = np.zeros(BUCKETS >> shift)
        tables[r["lang"]][[x["bucket"] for x in r["c"]]] = [x["n"] for x in r["c"]]
    names = sorted(tables)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    c = np.stack([tables[k] for k in names], axis=1) + SMOOTHING
    return names, np.log(c / c.sum(axis=0)).astype(np.float32)


def _em(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, head: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document after EM, and its log-likelihood."""
    total = np.add.reduceat(weight, head)
    for _ in range(rounds):
        r = share[doc] * like
        r *= (weight / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(r, head, axis=0) / total[:, None]
    mixed = np.maximum((share[doc] * like).sum(axis=1), 1e-300)
    return share, np.add.reduceat(weight * np.log(mixed), head)


def infer(like: np.ndarray, weight: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Language shares of each document; rows are distinct (document, word)
    pairs in document order, ``like`` their likelihoods (largest 1)."""
    head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    local = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(doc))))
    n, langs = len(head), like.shape[1]
    share, _ = _em(like, weight, local, head, np.full((n, langs), 1.0 / langs), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    size = np.log(np.maximum(np.add.reduceat(weight, head), 2))
    start = np.zeros((n, langs))
    np.put_along_axis(start, order[:, :1], 1.0, axis=1)
    best, best_value = _em(like, weight, local, head, start, 1)
    live = np.arange(n)         # documents that may take one more language
    for k in range(2, langs + 1):
        if not len(live):
            break
        rows = np.flatnonzero(np.isin(local, live))
        part = np.searchsorted(live, local[rows])
        start = np.zeros((len(live), langs))
        np.put_along_axis(start, order[live, :k], 1.0 / k, axis=1)
        got, value = _em(like[rows], weight[rows], part, np.flatnonzero(np.diff(part, prepend=-1)), start, ROUNDS)
        value = value - PENALTY * (k - 1) * size[live]
        better = value > best_value[live]
        live, got, value = live[better], got[better], value[better]
        best[live], best_value[live] = got, value
    return best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fold, language, its share, and the mixture."""
    names, logp = model
    langs, joined = len(names), (BUCKETS // max(1, len(logp))).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = S.flat(b.column(1))
            n = len(off) - 1
            share = np.zeros((n, langs))
            for lo, hi in S.chunks(off, max(1 << 16, S.CHUNK_BYTES // max(1, langs // 8))):
                part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
                st, en, inv, first = _words(part, o)
                if not len(st) or not langs:
                    continue
                gram, at = _trigrams(part, st, en)
                like = np.add.reduceat(logp[gram >> joined], at[:-1], axis=0).astype(np.float64)
                like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -60.0))
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                pair, weight = np.unique(doc * len(st) + inv, return_counts=True)
                doc, word = pair // len(st), pair % len(st)
                share[lo + np.unique(doc)] = infer(like[word], weight.astype(np.float64), doc)
            letter = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & (share.sum(axis=1) > 0)
            top = share.argmax(axis=1) if langs else np.zeros(n, np.int64)
            pred = [names[t] if ok else "und" for t, ok in zip(top.tolist(), letter.tolist())]
            score = np.where(letter, share.max(axis=1) if langs else 0.0, 0.0)
            mix = [[{"lang": names[k], "share": float(row[k])} for k in np.argsort(-row, kind="stable") if row[k] > 0] if ok else []
                   for row, ok in zip(share, letter.tolist())]
            yield pa.record_batch([b.column(0).cast(pa.int64()), b.column(3), pa.array(pred, pa.string()),
                                   pa.array(np.minimum(score, 1.0)),
                                   pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                                  names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    text = docs[text_col]
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"),
                       F.coalesce(fold(docs[id_col], FOLDS) == HELD, F.lit(False)).alias("held_out")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the documents that are not held out, predict for all."""
    return predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
