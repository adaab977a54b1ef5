"""Operator 9: benchmark decontamination through FM-indexes.

Each Arrow batch of documents is a training shard.  Its words are mapped to
the alphabet of the test windows (a word no window holds can be in no
occurrence and ends a run; runs shorter than the shortest window are left
out), and the runs are indexed: suffix order, Burrows-Wheeler transform,
wavelet matrix, suffix positions sampled at every ``SAMPLE``-th place of a run.
All windows are searched backwards at once through wavelet ranks; the rows
found are located by stepping to sampled positions, and the occurrences are
merged into spans of document words.

Words are compared by 64-bit hash.  The benchmark is taken in blocks of at
most ``BLOCK_BYTES`` of text (or one item): each block is a pass of its own
over the whole texts and the spans found so far, so no task and no closure
holds more than a block, whatever the size of the benchmark, and the number of
blocks never shows in the result.

Cases: NULL texts have no words, no hits and no items; items without words
have no window; items with a NULL id are searched and cut like all others and
are one more item without a name (a NULL in ``items``, counted, not in the
hash of the names); equal windows of several items count for each; rows that
repeat a doc_id are separate; empty tables give empty results or results
without hits; columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import textspans as S

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 4 << 20
SHARD_TEXT = 8 << 20

SPANS = "array<struct<first:bigint,last:bigint>>"
FIELDS = f"doc_id bigint, text string, n_words bigint, spans {SPANS}, items array<string>"


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence of small integers."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        cur = seq
        for k in range(self.bits - 1, -1, -1):
            bit = ((cur >> k) & 1).astype(bool)
            ones = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(cur) - int(ones[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        # where each symbol's run begins at the bottom
        self.start = np.zeros(sigma, dtype=np.int64)
        sym = np.arange(sigma)
        pos = np.zeros(sigma, dtype=np.int64)
        for level, (ones, zero) in enumerate(zip(self.levels, self.zeros)):
            bit = (sym >> (self.bits - 1 - level)) & 1
            pos = np.where(bit == 1, zero + ones[pos], pos - ones[pos])
        self.start = pos

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of sym before pos, for arrays of both."""
        p = pos
        for level, (ones, zero) in enumerate(zip(self.levels, self.zeros)):
            o = ones[p]
            p = np.where((sym >> (self.bits - 1 - level)) & 1, zero + o, p - o)
        return p - self.start[sym]

    def access(self, pos: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        p, out = pos, np.zeros(len(pos), dtype=np.int64)
        for ones, zero in zip(self.levels, self.zeros):
            o = ones[p]
            bit = (ones[p + 1] - o).astype(bool)
            out = out * 2 + bit
            p = np.where(bit, zero + o, p - o)
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix array of symbols in which every 0 (the separator) is unique:
    smaller than all other symbols and ordered by place."""
    n = len(seq)
    zero = seq == 0
    m = int(zero.sum())
    rank = seq.astype(np.int64) + m
    rank[zero] = np.arange(m)
    order = np.argsort(rank, kind="stable")
    h = 1
    sorted_rank = rank[order]
    new = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    while True:
        # only the groups of more than one suffix are sorted again
        group_end = np.concatenate([new[1:], [True]])
        open_ = ~(new & group_end)
        if not open_.any():
            return order
        at = np.flatnonzero(open_)
        suf = order[at]
        nxt = np.where(suf + h < n, rank[np.minimum(suf + h, n - 1)], -1)
        by = np.lexsort((nxt, rank[suf]))
        suf, nxt = suf[by], nxt[by]
        old = rank[suf]
        order[at] = suf
        first = np.concatenate([[True], (old[1:] != old[:-1]) | (nxt[1:] != nxt[:-1])])
        new[at] = first
        rank[suf] = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        h *= 2


class FMIndex:
    """Index of runs of symbols 1.., each run closed by the separator 0."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(seq)
        order = suffix_order(seq)
        bwt = seq[order - 1]            # order 0 takes the last symbol, a separator
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        zero = np.flatnonzero(seq == 0)
        starts = np.concatenate([[0], zero[:-1] + 1])
        place = np.arange(n) - np.repeat(starts, zero - starts + 1)
        marked = (place % sample == 0)[order]
        self.marks = np.concatenate([[0], np.cumsum(marked)])
        self.sampled = order[marked]
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (a matrix, right-aligned), backwards."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            sym = patterns[live, width - 1 - k]
            lo[live] = self.first[sym] + self.wavelet.rank(sym, lo[live])
            hi[live] = self.first[sym] + self.wavelet.rank(sym, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows."""
        out = np.empty(len(rows), dtype=np.int64)
        at, idx, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            done = self.marks[at + 1] > self.marks[at]
            out[idx[done]] = self.sampled[self.marks[at[done]]] + steps
            at, idx = at[~done], idx[~done]
            sym = self.wavelet.access(at)
            at = self.first[sym] + self.wavelet.rank(sym, at)
            steps += 1
        return out


class Windows:
    """The distinct windows of a block of items, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        col = pa.array([t for _, t in items], pa.string())
        buf, off = S.flat(col)
        st, en = S.word_spans(buf, off, S.ALNUM)
        first = S.per_document(st, off)
        self.raw = S.FOLD[buf]
        for seed in itertools.count(42):    # values under which the words of the items do not collide
            self.values = S.byte_values(seed)
            self.vocabulary, at, sym = np.unique(S.span_hashes(self.raw, st, en, self.values), return_index=True, return_inverse=True)
            self.starts, self.ends = st[at], en[at]
            if S.same_spans(self.raw, st, en, self.raw, self.starts[sym], self.ends[sym]).all():
                break
        sym = sym + 1
        seen: dict[bytes, int] = {}
        owners: list[set[int]] = []
        rows, lengths = [], []
        for i in range(len(items)):
            a, b = int(first[i]), int(first[i + 1])
            size = min(window, b - a)
            for j in range(a, b - size + 1) if size else ():
                w = sym[j:j + size]
                k = seen.setdefault(w.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(np.concatenate([np.zeros(window - size, np.int64), w]))
                    lengths.append(size)
                    owners.append(set())
                owners[k].add(i)
        self.patterns = np.array(rows, dtype=np.int64).reshape(len(rows), window)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.shortest = int(self.lengths.min()) if rows else 0
        self.owner_count = np.array([len(x) for x in owners], dtype=np.int64)
        self.owner_first = np.concatenate([[0], np.cumsum(self.owner_count)])
        self.owners = np.array([y for x in owners for y in sorted(x)], dtype=np.int64)
        self.names = [None if i is None else str(i) for i, _ in items]


def search_shard(col, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document, hit mask over the words of the shard, first
    word of each document, and distinct (document, item) pairs."""
    buf, off = S.flat(col)
    n = len(off) - 1
    words = np.zeros(n, dtype=np.int64)
    runs, places, total = [], [], 0
    first_of = np.zeros(n + 1, dtype=np.int64)
    for lo, hi in S.chunks(off):
        b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        st, en = S.word_spans(b, o, S.ALNUM)
        first = S.per_document(st, o)
        first_of[lo + 1:hi + 1] = total + first[1:]
        words[lo:hi] = np.diff(first)
        if win.shortest and len(st):
            b = S.FOLD[b]
            h = S.span_hashes(b, st, en, win.values)
            k = np.minimum(np.searchsorted(win.vocabulary, h), len(win.vocabulary) - 1)
            known = win.vocabulary[k] == h
            at = np.flatnonzero(known)      # an equal hash is not yet the word
            known[at] = S.same_spans(b, st[at], en[at], win.raw, win.starts[k[at]], win.ends[k[at]])
            # runs of known words inside documents
            rs, re_ = _runs(known, first)
            long = re_ - rs >= win.shortest
            rs, re_ = rs[long], re_[long]
            if len(rs):
                size = re_ - rs + 1
                seq = np.append(k + 1, 0)[S.ranges(rs, size)]
                ends = np.cumsum(size) - 1
                seq[ends] = 0
                runs.append(seq)
                places.append(S.ranges(total + rs, size))
        total += len(st)
    mask = np.zeros(total, dtype=bool)
    none = np.zeros(0, np.int64)
    if not runs:
        return words, mask, first_of, none, none
    seq, place = np.concatenate(runs), np.concatenate(places)
    index = FMIndex(seq, len(win.vocabulary) + 1)
    lo, hi = index.search(win.patterns, win.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return words, mask, first_of, none, none
    depth = np.zeros(total + 1, dtype=np.int64)
    pairs = []
    counts = (hi - lo)[found]
    cut = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(found):   # blocks of at most about a million occurrences
        b = max(a + 1, int(np.searchsorted(cut, cut[a] + (1 << 20), side="right")) - 1)
        which = np.repeat(found[a:b], counts[a:b])
        at = place[index.locate(S.ranges(lo[found[a:b]], counts[a:b]))]
        np.add.at(depth, at, 1)
        np.add.at(depth, at + win.lengths[which], -1)
        doc = np.searchsorted(first_of, at, side="right") - 1
        many = win.owner_count[which]
        item = win.owners[S.ranges(win.owner_first[which], many)]
        pairs.append(np.unique(np.repeat(doc, many) * len(win.names) + item))
        a = b
    pairs = np.unique(np.concatenate(pairs))
    return words, np.cumsum(depth)[:-1] > 0, first_of, pairs // len(win.names), pairs % len(win.names)


def _runs(flag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True inside documents."""
    head = flag.copy()
    head[1:] &= ~flag[:-1]
    edges = first[1:-1]
    edges = edges[(edges > 0) & (edges < len(flag))]
    head[edges] = flag[edges]
    tail = flag.copy()
    tail[:-1] &= ~flag[1:]
    tail[edges - 1] = flag[edges - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def _shards(batch: pa.RecordBatch, col: int = 1) -> Iterator[pa.RecordBatch]:
    size = np.diff(S.flat(batch.column(col))[1])
    total = np.concatenate([[0], np.cumsum(size)])
    for lo, hi in S.chunks(total, SHARD_TEXT):
        yield batch.slice(lo, hi - lo)


def _merge(old: list, new: list) -> list:
    out: list = []
    for a, b in sorted(old + new):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans_with(col: pa.Array, mask: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int]]]:
    """The spans of each document (a column of them) merged with its hit words."""
    a, z = _runs(mask, first)
    owner = np.searchsorted(first, a, side="right") - 1
    spans: list[list] = [[(x["first"], x["last"]) for x in s] if s else [] for s in col.to_pylist()]
    docs_hit, cut = np.unique(owner, return_index=True)   # owner is sorted
    for d, lo, hi in zip(docs_hit.tolist(), cut.tolist(), [*cut[1:].tolist(), len(owner)]):
        spans[d] = _merge(spans[d], list(zip((a[lo:hi] - first[d]).tolist(), (z[lo:hi] - 1 - first[d]).tolist())))
    return spans


def _span_column(spans: list[list[tuple[int, int]]]) -> pa.Array:
    flat = [x for s in spans for x in s]
    off = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), pa.int32())
    pair = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()),
                                       pa.array([x[1] for x in flat], pa.int64())], names=["first", "last"])
    return pa.ListArray.from_arrays(off, pair)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most ``most`` bytes of text; one block is on
    the driver at a time."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("i"), benchmark[text_col].alias("t"))
    total = int(items.agg(F.coalesce(F.sum(F.octet_length("t").cast("bigint") + 64), F.lit(0))).first()[0])
    n = max(1, -(-total * 2 // most)) if total > most else 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield sorted([(r["i"], r["t"]) for r in part.collect()], key=lambda x: (x[0] is None, x[0] or ""))


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, text, words, spans of hit words (word
    numbers, both ends included) and the items found (sorted)."""
    out = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"),
                      F.lit(0).cast("bigint").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"),
                      F.lit(None).cast("array<string>").alias("items"))
    for items in blocks(benchmark, item_col, item_text, block_bytes):
        out = out.mapInArrow(_pass(items, window), FIELDS)
    return out


def _pass(items: list[tuple[str, str | None]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Windows(items, window)
        for whole in batches:
            for b in _shards(whole):
                words, mask, first, doc, item = search_shard(b.column(1), win)
                spans = _spans_with(b.column(3), mask, first)
                names: list[set] = [set(x) if x else set() for x in b.column(4).to_pylist()]
                for d, i in zip(doc.tolist(), item.tolist()):
                    names[d].add(win.names[i])
                yield pa.record_batch([b.column(0), b.column(1), pa.array(words, pa.int64()),
                                       _span_column(spans),
                                       pa.array([sorted(x - {None}) + [None] * (None in x) for x in names], pa.list_(pa.string()))],
                                      names=["doc_id", "text", "n_words", "spans", "items"])

    return run


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_spans``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cut_spans(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> list[str | None]:
    """The texts without the words of the spans (and what lies between them)."""
    out = []
    for text, cut in zip(texts.to_pylist(), spans):
        if not cut or text is None:
            out.append(text)
            continue
        raw = text.encode()
        buf = np.frombuffer(raw, np.uint8)
        st, en = S.word_spans(buf, np.array([0, len(buf)]), S.ALNUM)
        kept, at = [], 0
        for a, b in cut:
            kept.append(raw[at:st[a]])
            at = int(en[b])
        kept.append(raw[at:])
        out.append(b"".join(kept).decode("utf-8", "replace"))
    return out


def brute_force(rows: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Plain rendering of the contract for small inputs."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().lower())
    wins: dict[tuple, set] = {}
    for item, text in items:
        w = split(text)
        size = min(window, len(w))
        for j in range(len(w) - size + 1) if size else ():
            wins.setdefault(tuple(w[j:j + size]), set()).add(None if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in rows:
        w = split(text)
        hit, names = [False] * len(w), set()
        for size in sizes:
            for j in range(len(w) - size + 1):
                if (own := wins.get(tuple(w[j:j + size]))) is not None:
                    hit[j:j + size] = [True] * size
                    names |= own
        out.append((doc_id, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names - {None})).encode()).hexdigest(), any(hit)))
    return out


def cut(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
        item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, without the words of benchmark windows.  A
    document that had words and has none left goes.  Every block is searched in
    the whole texts; the spans of all blocks are cut by the last pass."""
    at, schema = docs.columns.index(text_col), docs.schema
    held = "_spans"
    while held in docs.columns:
        held += "_"
    docs = docs.select("*", F.lit(None).cast(SPANS).alias(held))
    found, names, last = docs.schema, docs.columns, None
    for items in blocks(benchmark, item_col, item_text, block_bytes):
        if last is not None:
            docs = docs.mapInArrow(_cut_pass(last, window, at, names), found)
        last = items
    return docs.mapInArrow(_cut_pass(last, window, at, names, True), schema)


def _cut_pass(items: list[tuple[str, str | None]], window: int, at: int, names: list[str], last: bool = False):
    """Adds the block's spans to the last column; the last pass cuts them all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = Windows(items, window)
        for whole in batches:
            for b in _shards(whole, at):
                words, mask, first, _, _ = search_shard(b.column(at), win)
                spans = _spans_with(b.column(b.num_columns - 1), mask, first)
                kept = list(b.columns[:-1])
                if not last:
                    yield pa.record_batch([*kept, _span_column(spans)], names=names)
                    continue
                kept[at] = pa.array(cut_spans(b.column(at), spans), pa.string())
                left = words - np.array([sum(y - x + 1 for x, y in s) for s in spans], dtype=np.int64)
                yield pa.record_batch(kept, names=names[:-1]).filter(pa.array((words == 0) | (left > 0)))

    return run
