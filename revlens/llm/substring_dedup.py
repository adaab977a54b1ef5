"""Operator 10: removal of token windows that occurred before.

Every window of ``window`` consecutive words is hashed (Rabin-Karp).  Chunks
are ranges of doc_id in order, so "starts earlier" means: in an earlier
chunk, or earlier in the same chunk.  Each chunk sends its distinct window
hashes to hash buckets (see ``hash_exchange``); a bucket answers with one bit
a hash: whether an earlier chunk has it.  The chunk then merges its repeated
windows into maximal removal intervals.  Only hashes and bits are shuffled
besides the texts themselves, whose exchange both passes share.

Hashes have 64 bits: two different windows among n collide with probability
about n^2 / 2^65 (1e-3 for 2e8 windows).

Cases: NULL or blank texts have no words and keep the empty text; documents
of fewer words than the window lose nothing; rows that repeat a doc_id are
taken in the order of their texts, equal rows one after the other (the later
ones lose what the first holds); NULL ids come before all others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import hash_exchange as X
from revlens.llm import textspans as S

WINDOW = 20
ASK = "chunk bigint, bucket bigint, hashes binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:bigint,last:bigint>>, kept_text string"


def _by_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """Documents with the number of their doc_id range; the bounds are one
    number for ``CHUNK_TEXT`` bytes of text."""
    at = [i / chunks for i in range(1, chunks)]
    got = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in at]) if chunks <= 64 else F.lit(at),
                                       max(10_000, 20 * chunks))).first()[0]
    bounds = np.unique(np.array(got or [], dtype=np.int64))

    @F.pandas_udf("bigint")
    def number(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int64)
        out[known] = np.searchsorted(bounds, ids[known].to_numpy(dtype=np.int64), side="left")
        return pd.Series(out)

    return docs.withColumn("chunk", number("doc_id"))


def _in_order(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    keys = pa.table({"id": table["doc_id"], "null": pc.is_valid(table["doc_id"]).cast(pa.int8()), "text": table["text"]})
    if pc.count_distinct(keys["id"], mode="all").as_py() == len(keys):
        keys = keys.drop(["text"])
    order = [(k, "ascending") for k in ("null", "id", "text") if k in keys.column_names]
    return table.take(pc.sort_indices(keys, sort_keys=order))


def _words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, ends, hashes, and first word of each document."""
    buf, off = S.flat(table["text"])
    st, en = S.word_spans(buf, off, S.NOT_BLANK)
    hashes = np.empty(len(st), dtype=np.uint64)
    first = S.per_document(st, off)
    for lo, hi in S.chunks(off):
        a, b = first[lo], first[hi]
        hashes[a:b] = S.span_hashes(buf[off[lo]:off[hi]], st[a:b] - off[lo], en[a:b] - off[lo])
    return buf, st, en, hashes, first


def _windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows inside documents."""
    room = np.maximum(np.diff(first) - size + 1, 0)
    at = S.ranges(first[:-1], room)
    out = np.empty(len(at), dtype=np.uint64)
    done, step = 0, 1 << 20
    while done < len(at):   # blocks bound the working memory and the table of powers
        to = min(done + step, len(at))
        base = at[done]
        block = S.window_hashes(hashes[base:at[to - 1] + size], size) if at[to - 1] - base <= 4 * step else None
        if block is None:   # long gaps of short documents: fewer windows at a time
            to = int(np.searchsorted(at, base + 4 * step, side="right"))
            block = S.window_hashes(hashes[base:at[to - 1] + size], size)
        out[done:to] = block[at[done:to] - base]
        done = to
    return at, out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, removed words, removed intervals (word
    numbers, both ends included) and the kept words joined by one space."""
    d = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    chunks, buckets = X.sizes(X.text_bytes(d, "text"))
    d = _by_chunk(d, chunks)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, _, h, first = _words(table)
        rows = list(X.pack(np.unique(_windows(h, first, window)[1]), buckets))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "bucket": pa.array([r[0] for r in rows], pa.int64()),
                         "hashes": pa.array([r[3] for r in rows], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        parts = [X.unpack(key[0].as_py(), x, buckets) for x in table["hashes"].to_pylist()]
        _, at, inv = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        seen = at[inv] != np.arange(len(inv))
        cut = np.cumsum([0] + [len(p) for p in parts])
        rows = [(c, seen[lo:hi]) for c, lo, hi in zip(table["chunk"].to_pylist(), cut[:-1], cut[1:]) if seen[lo:hi].any()]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()),
                         "bucket": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         "hashes": pa.array([np.packbits(x).tobytes() for _, x in rows], pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _in_order(left)
        n = len(table)
        buf, st, en, h, first = _words(table)
        at, win = _windows(h, first, window)
        uniq, head, inv = np.unique(win, return_index=True, return_inverse=True)
        seen = np.zeros(len(uniq), dtype=bool)
        place = X.places(uniq, buckets)
        for b, bits in zip(right["bucket"].to_pylist(), right["hashes"].to_pylist()):
            lo, hi = place[b]
            seen[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        again = at[seen[inv] | (head[inv] != np.arange(len(inv)))]
        depth = np.zeros(len(st) + 1, dtype=np.int64)
        np.add.at(depth, again, 1)
        np.add.at(depth, again + window, -1)
        gone = np.cumsum(depth)[:-1] > 0
        return _result(table["doc_id"], buf, st, en, first, gone, n)

    asked = d.groupBy("chunk").applyInArrow(ask, ASK)
    answered = asked.groupBy("bucket").applyInArrow(answer, ASK)
    return d.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(remove, RESULT)


def _result(ids, buf, st, en, first, gone, n) -> pa.Table:
    kept = ~gone
    words = np.diff(first)
    upto = np.concatenate([[0], np.cumsum(gone)])
    removed = upto[first[1:]] - upto[first[:-1]]
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    starts = first[:-1][words > 0]
    edge[starts] = gone[starts]
    tail = gone.copy()
    tail[:-1] &= ~gone[1:]
    ends = first[1:][words > 0] - 1
    tail[ends] = gone[ends]
    a, b = np.flatnonzero(edge), np.flatnonzero(tail)
    run_off = np.searchsorted(a, first)
    base = np.repeat(first[:-1], np.diff(run_off))
    spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], names=["first", "last"])
    # kept words, each with one following blank; the last blank of a document is left out
    ks, ke = st[kept], en[kept]
    size = ke - ks + 1
    kept_off = np.searchsorted(np.flatnonzero(kept), first)
    cut = np.concatenate([[0], np.cumsum(size)])
    idx = S.ranges(ks, size)
    out = np.append(buf, np.uint8(0x20))[idx]
    out[cut[1:] - 1] = 0x20
    lo, hi = cut[kept_off[:-1]], cut[kept_off[1:]]
    data = out.tobytes()
    texts = [data[x:max(x, y - 1)].decode("utf-8", "replace") for x, y in zip(lo.tolist(), hi.tolist())]
    return pa.table({"doc_id": ids.cast(pa.int64()), "n_words": pa.array(words, pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()),
                     "removed": pa.ListArray.from_arrays(pa.array(run_off, pa.int32()), spans),
                     "kept_text": pa.array(texts, pa.string())})


def digest(result: DataFrame) -> DataFrame:
    """The digest columns of a result."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """Plain rendering of the contract for small inputs with distinct ids."""
    seen: set[tuple] = set()
    out = []
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            if w in seen:
                gone[i:i + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
