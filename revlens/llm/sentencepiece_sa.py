"""Operator 1: SentencePiece encoding and decoding by suffix-array matching.

The vocabulary file is a SentencePiece BPE model with byte fallback.  Texts
are cut where two neighbouring bytes stand side by side in no piece (proved
from the vocabulary once, offline): no merge can cross such a place, so the
units between them are encoded alone.  The distinct units of a shard of texts
are concatenated and indexed by a suffix array; every piece is searched by
bisection for its range of occurrences, and each occurrence is an edge from
its start to its end.

The edges are sorted by end position and relaxed in that order.  For BPE the
label of a position is the last token of the encoding of the prefix that ends
there; an edge relaxes its end if its token may follow the label of its start,
that is, if merging the two tokens' characters alone by score gives back these
two tokens.  A sequence of tokens is the BPE encoding of its text exactly if
all its neighbours pass this test, so one edge wins at each position, and the
labels are equal to the library's encoding.  Tests of token pairs are
remembered.  A character that no piece matches is a byte-fallback edge.

Cases: NULL and empty texts have no tokens; U+2581 in a text is a blank to the
library and decodes as one (``round_trip`` is then false); NUL and other
characters outside the vocabulary are byte tokens; rows that repeat an id are
separate; empty tables give empty results; other columns are not read.  No
text is cut short: a long unit without a cut is one unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from revlens.llm import textspans as S

SHARD_TEXT = 12 << 20
INDEX_BYTES = 1 << 17
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean"
MEMO = 1 << 22
_BLANK = "▁"

_models: dict[str, Model] = {}


class Model:
    """Pieces of a vocabulary file, the places where texts may be cut, and
    the remembered tests of token pairs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        ids = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i).replace(_BLANK, " ") for i in ids}
        self.score = np.full(self.size + 1, -np.inf)
        self.score[ids] = [sp.get_score(i) for i in ids]
        raw = {i: text[i].encode() for i in ids}
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        # decoding table
        table = [b""] * self.size
        for i, b in raw.items():
            table[i] = b
        for b in range(256):
            table[self.byte_id[b]] = bytes([b])
        self.piece_off = np.concatenate([[0], np.cumsum([len(x) for x in table])])
        self.piece_bytes = np.frombuffer(b"".join(table), np.uint8)
        # neighbouring bytes inside pieces
        self.joined = np.zeros((256, 256), dtype=bool)
        for b in raw.values():
            a = np.frombuffer(b, np.uint8)
            self.joined[a[:-1], a[1:]] = True
        # pieces in byte order, as two 8-byte keys
        order = sorted(ids, key=lambda i: raw[i])
        self.pieces = np.array(order, dtype=np.int64)
        self.length = np.array([len(raw[i]) for i in order], dtype=np.int64)
        self.longest = int(self.length.max())
        pad = [raw[i].ljust(16, b"\0") for i in order]
        self.low1 = np.array([int.from_bytes(b[:8], "big") for b in pad], dtype=np.uint64)
        self.low2 = np.array([int.from_bytes(b[8:16], "big") for b in pad], dtype=np.uint64)
        rest1 = np.maximum(8 - self.length, 0).astype(np.uint64) * np.uint64(8)
        self.high1 = np.where(rest1 > 0, self.low1 | ((np.uint64(1) << rest1) - np.uint64(1)), self.low1)
        rest2 = np.clip(16 - self.length, 0, 7).astype(np.uint64) * np.uint64(8)
        self.high2 = self.low2 | ((np.uint64(1) << rest2) - np.uint64(1))
        self.tails = {k: np.frombuffer(raw[i][16:], np.uint8) for k, i in enumerate(order) if len(raw[i]) > 16}
        # characters of each piece, and what two pieces merge into
        by_text = {t: i for i, t in text.items()}
        self.n_chars = np.zeros(self.size, dtype=np.int64)
        self.chars: list[list[int]] = [[]] * self.size
        keys, made = [], []
        for i, t in text.items():
            self.chars[i] = [by_text.get(c, self.size) for c in t]
            self.n_chars[i] = len(t)
            for k in range(1, len(t)):
                a, b = by_text.get(t[:k]), by_text.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * (self.size + 1) + b)
                    made.append(i)
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.merge_key = np.append(np.array(keys, dtype=np.int64)[by], np.iinfo(np.int64).max)
        self.merge_to = np.append(np.array(made, dtype=np.int64)[by], self.size)
        width = int(self.n_chars.max())
        self.char_rows = np.full((self.size, width), -1, dtype=np.int32)
        for i in ids:
            self.char_rows[i, :len(self.chars[i])] = self.chars[i]
        self.memo_key = np.full(MEMO, -1, dtype=np.int64)
        self.memo_ok = np.zeros(MEMO, dtype=bool)
        self.alone = np.zeros(self.size, dtype=bool)
        self.alone[ids] = self._merges_back(np.array(ids), None)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge into, or ``size``."""
        key = a.astype(np.int64) * (self.size + 1) + b
        at = np.searchsorted(self.merge_key, key)
        return np.where(self.merge_key[at] == key, self.merge_to[at], self.size)

    def _merges_back(self, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        """Whether merging the characters of a (and b) by score, leftmost
        first, ends in exactly these tokens."""
        out = np.zeros(len(a), dtype=bool)
        total = self.n_chars[a] + (0 if b is None else self.n_chars[b])
        by = np.argsort(total, kind="stable")
        for lo in range(0, len(a), 50_000):
            part = by[lo:lo + 50_000]
            out[part] = self._merge_rows(a[part], None if b is None else b[part])
        return out

    def _merge_rows(self, a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
        n, left = len(a), self.n_chars[a]
        count = left + (0 if b is None else self.n_chars[b])
        width = int(count.max()) if n else 0
        sym = np.full((n, width + 1), self.size, dtype=np.int64)
        col = np.arange(self.char_rows.shape[1])
        r, c = np.nonzero(col[None, :] < left[:, None])
        sym[r, c] = self.char_rows[a[r], c]
        if b is not None:
            r, c = np.nonzero(col[None, :] < self.n_chars[b][:, None])
            sym[r, left[r] + c] = self.char_rows[b[r], c]
        bound = left.copy()
        ok = np.zeros(n, dtype=bool)
        live = np.arange(n)
        pair = self._merged(sym[:, :-1], sym[:, 1:])
        while len(live):
            score = self.score[pair]
            best = score.argmax(axis=1)
            row = np.arange(len(live))
            ended = score[row, best] == -np.inf
            done = live[ended]
            ok[done] = (count[done] == (1 if b is None else 2)) & (bound[done] == 1)
            crossing = np.zeros(len(live), dtype=bool) if b is None else best + 1 == bound[live]
            keep = ~(ended | crossing)
            live, sym, pair, best = live[keep], sym[keep], pair[keep], best[keep]
            if not len(live):
                break
            row = np.arange(len(live))
            new = pair[row, best]
            # drop the second symbol of the merged pair
            cols = np.arange(sym.shape[1])
            src = np.minimum(cols[None, :] + (cols[None, :] > best[:, None]), sym.shape[1] - 1)
            sym = np.take_along_axis(sym, src, axis=1)
            sym[row, best] = new
            count[live] -= 1
            bound[live] -= best + 1 < bound[live]
            last = sym.shape[1] - 1
            sym[row, np.minimum(count[live], last)] = self.size
            pair = np.take_along_axis(pair, np.minimum(src[:, :-1], pair.shape[1] - 1), axis=1)
            pair[row, best] = self._merged(sym[row, best], sym[row, best + 1])
            back = best > 0
            pair[row[back], best[back] - 1] = self._merged(sym[row[back], best[back] - 1], sym[row[back], best[back]])
            pair[row, np.minimum(np.maximum(count[live] - 1, 0), pair.shape[1] - 1)] = self.size
        return ok

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The remembered test of token pairs."""
        key = a.astype(np.int64) * self.size + b
        slot = ((key.astype(np.uint64) * np.uint64(S.BASE)) >> np.uint64(64 - MEMO.bit_length() + 1)).astype(np.int64)
        known = self.memo_key[slot] == key
        ok = self.memo_ok[slot]
        if not known.all():
            fresh, inv = np.unique(key[~known], return_inverse=True)
            got = self._merges_back(fresh // self.size, fresh % self.size)
            ok[~known] = got[inv]
            slot = ((fresh.astype(np.uint64) * np.uint64(S.BASE)) >> np.uint64(64 - MEMO.bit_length() + 1)).astype(np.int64)
            self.memo_key[slot] = fresh
            self.memo_ok[slot] = got
            # of two pairs that share a slot the later key was kept; make its value agree
            self.memo_ok[slot] = np.where(self.memo_key[slot] == fresh, got, self.memo_ok[slot])
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all occurrences of pieces in the bytes."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(24, np.uint8)]).tobytes()
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        key1 = np.ndarray((n,), ">u8", padded, 0, (1,))[starts].astype(np.uint64)
        key2 = np.ndarray((n,), ">u8", padded, 8, (1,))[starts].astype(np.uint64)
        by = np.lexsort((key2, key1))           # the suffix array, as deep as two keys
        order, key1, key2 = starts[by], key1[by], key2[by]
        lo = np.searchsorted(key1, self.low1, side="left")
        hi = np.searchsorted(key1, self.high1, side="right")
        for k in np.flatnonzero((self.length > 8) & (hi > lo)).tolist():
            a, b = lo[k], hi[k]
            lo[k] = a + np.searchsorted(key2[a:b], self.low2[k], side="left")
            hi[k] = a + np.searchsorted(key2[a:b], self.high2[k], side="right")
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        at = order[S.ranges(lo, count)]
        if self.tails:
            good = np.ones(len(at), dtype=bool)
            cut = np.concatenate([[0], np.cumsum(count)])
            for k, tail in self.tails.items():
                if count[k]:
                    p = at[cut[k]:cut[k + 1]]
                    idx = np.minimum(p[:, None] + 16 + np.arange(len(tail))[None, :], n - 1)
                    good[cut[k]:cut[k + 1]] = (text[idx] == tail[None, :]).all(axis=1) & (p + 16 + len(tail) <= n)
            at, which = at[good], which[good]
        return at, at + self.length[which], self.pieces[which]

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all units in order, and the n + 1 offsets."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        text = np.frombuffer(b"\0".join(units) + b"\0", np.uint8)
        first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        start, end, piece = self.edges(text)
        # characters that no piece of one character matches: byte fallback
        head = (text & 0xC0) != 0x80
        sep = first + size
        head[sep] = False
        heads = np.flatnonzero(head)
        stop = np.append(heads[1:], len(text))
        stop = np.minimum(stop, sep[np.searchsorted(first, heads, side="right") - 1])
        covered = np.zeros(len(text), dtype=bool)
        char_end = np.zeros(len(text), dtype=np.int64)
        char_end[heads] = stop
        covered[start[char_end[start] == end]] = True
        odd = heads[~covered[heads]]
        FREE, BYTES = -2, self.size
        start = np.concatenate([start, odd])
        end = np.concatenate([end, char_end[odd]])
        piece = np.concatenate([piece, np.full(len(odd), BYTES)])
        owner = np.searchsorted(first, start, side="right") - 1
        place = end - first[owner]
        small = place.astype(np.uint16) if len(place) and place.max() < 65536 else place
        by = np.argsort(small, kind="stable")
        start, end, piece, place = start[by], end[by], piece[by], place[by]
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
        label = np.full(len(text) + 1, -1, dtype=np.int64)
        back = np.zeros(len(text) + 1, dtype=np.int64)
        label[first] = FREE
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            s, t = start[a:b], piece[a:b]
            before = label[s]
            byte = t == BYTES
            free = (before == FREE) | (before == BYTES)
            ok = byte | (free & self.alone[np.where(byte, 0, t)])
            ask = np.flatnonzero(~byte & ~free & (before >= 0))
            ok[ask] = self.may_follow(before[ask], t[ask])
            e = end[a:b][ok]
            label[e] = t[ok]
            back[e] = s[ok]
        # from the end of each unit back along the winning edges
        token = np.full(len(text), -1, dtype=np.int32)
        cur = (first + size)[size > 0]
        head_of = first[size > 0]
        while len(cur):
            prev = back[cur]
            lab = label[cur]
            plain = lab != BYTES
            token[prev[plain]] = lab[plain]
            p, n = prev[~plain], (cur - prev)[~plain]
            at = S.ranges(p, n)
            token[at] = self.byte_id[text[at]]
            more = prev > head_of
            cur, head_of = prev[more], head_of[more]
        chosen = token >= 0
        upto = np.concatenate([[0], np.cumsum(chosen)])
        return token[chosen], np.append(upto[first], upto[-1])


def load(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _prefixed(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with a blank before each text that is not empty."""
    buf, off = S.flat(col)
    if len(buf) and _BLANK.encode() in buf.tobytes():
        col = pa.array([(t or "").replace(_BLANK, " ") for t in col.to_pylist()], pa.large_string())
        buf, off = S.flat(col)
    full = np.diff(off) > 0
    out = np.insert(buf, off[:-1][full], 0x20)
    return out, off + np.concatenate([[0], np.cumsum(full)])


def encode_texts(col, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts in order, and the n + 1 offsets."""
    buf, off = _prefixed(col)
    parts: list[tuple] = []
    number: dict[bytes, int] = {}       # distinct units of all chunks, by their bytes
    for lo, hi in S.chunks(off):
        b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        if not len(b):
            continue
        cut = np.ones(len(b), dtype=bool)
        cut[1:] = ~model.joined[b[:-1], b[1:]] & ((b[1:] & 0xC0) != 0x80)
        cut[o[:-1][o[:-1] < len(b)]] = True
        st = np.flatnonzero(cut)
        en = np.append(st[1:], len(b))
        at, inv = S.distinct_spans(b, st, en)
        data = b.tobytes()
        units = [number.setdefault(data[x:y], len(number)) for x, y in zip(st[at].tolist(), en[at].tolist())]
        parts.append((np.array(units, dtype=np.int32), inv.astype(np.int32), S.per_document(st, o), lo, hi))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    units = list(number)
    del number
    size = np.cumsum([len(u) + 1 for u in units])
    ids, lens, a = [], [], 0
    while a < len(units):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + INDEX_BYTES, side="right")))
        got, o = model.encode_units(units[a:b])
        ids.append(got)
        lens.append(np.diff(o))
        a = b
    unit_ids, unit_len = np.concatenate(ids), np.concatenate(lens)
    unit_off = np.concatenate([[0], np.cumsum(unit_len)])[:-1]
    out, counts = [], np.zeros(len(off) - 1, dtype=np.int64)
    for u, inv, first, lo, hi in parts:
        which = u[inv]
        n = unit_len[which]
        out.append(unit_ids[S.ranges(unit_off[which], n)])
        c = np.concatenate([[0], np.cumsum(n)])
        counts[lo:hi] = c[first[1:]] - c[first[:-1]]
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])


def decode_ids(ids: np.ndarray, off: np.ndarray, model: Model) -> pa.Array:
    """Texts of token ids: piece bytes, without the blank put before the text."""
    size = (model.piece_off[1:] - model.piece_off[:-1])
    cut = np.zeros(len(off), dtype=np.int64)
    out = []
    for lo, hi in S.chunks(off, 1 << 18):
        part = ids[off[lo]:off[hi]]
        n = size[part]
        b = model.piece_bytes[S.ranges(model.piece_off[:-1][part], n)]
        c = np.concatenate([[0], np.cumsum(n)])[off[lo:hi + 1] - off[lo]]
        head = c[:-1][np.diff(c) > 0]
        head = head[b[head] == 0x20]
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        gone[head + 1] = 1
        shift = np.cumsum(gone)
        out.append(np.delete(b, head))
        cut[lo + 1:hi + 1] = cut[lo] + c[1:] - shift[c[1:]]
    data = np.concatenate(out).tobytes() if out else b""
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut, dtype=np.int64)), pa.py_buffer(data)])


def _shards(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    off = S.flat(batch.column(col))[1]
    for lo, hi in S.chunks(off, SHARD_TEXT):
        yield batch.slice(lo, hi - lo)


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", path: str | None = None, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: id, number of tokens, token ids, and whether the
    decoded ids give back the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(S.tokenizer_file(vocabulary, path))
        for whole in batches:
            for b in _shards(whole, 1):
                ids, off = encode_texts(b.column(1), model)
                texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
                same = pa.compute.equal(decode_ids(ids, off, model), texts)
                lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))
                yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()), lists, same],
                                      names=["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, vocabulary: str = "piece_bpe_32k.model", path: str | None = None, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """One row per row of token ids: id and text (NULL ids: the empty text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(S.tokenizer_file(vocabulary, path))
        for b in batches:
            lists = b.column(1).cast(pa.large_list(pa.int32())).fill_null([])
            off = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))])
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = pa.array([x.decode("utf-8", "replace") for x in decode_ids(ids, off, model).to_pylist()], pa.string())
            yield pa.record_batch([b.column(0).cast(pa.int64()), texts], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id bigint, text string")
