"""Operator 2: exact token counts by the whole-token shortcut.

The vocabulary is examined once, offline: a vocabulary string is *whole* when
the library itself encodes that string, standing alone, as one token.  A text
is cut at ASCII blanks into units (white space never crosses a unit: the
normaliser and the pre-tokenizer of the file act on each side alone).  The
distinct units of an Arrow batch are found by hash and split into pre-tokens;
a pre-token that is whole counts one without any merging.  Only the remaining
distinct pre-tokens are given to the library's merge loop.  Each document's
count is the sum over its units.

Special strings inside texts follow the library's default: a unit that holds
``<|endoftext|>`` and the like goes to the library as it is, as does a unit
of rarer scripts or combining marks.

Cases: NULL text counts as empty (0 bytes, 0 tokens); empty tables give empty
results; repeated rows, NULL ids and extra columns are carried or ignored
(only id and text are read); one result row per input row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from revlens.llm import textspans as S

LIMIT = 2048
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

#: Fixed value: the split pattern of the vocabulary file.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Merged pre-tokens remembered between batches of a task, at most.
KNOWN_MOST = 400_000

_loaded: dict[str, tuple] = {}
DIGIT, ODD = 2, 4
#: 0 blanks, 1 letters (and bytes of non-ASCII characters), 2 digits, 3 other.
CLASSES = np.full(256, 3, dtype=np.uint8)
CLASSES[~S.NOT_BLANK] = 0
CLASSES[0x30:0x3A] = DIGIT
CLASSES[0x41:0x5B] = CLASSES[0x61:0x7B] = CLASSES[0x80:] = 1


def load(path: str):
    """The tokenizer and the set of proven whole-token words of a file."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        suffix = "</w>"
        words = [w[:-len(suffix)] for w in tok.get_vocab(with_added_tokens=False) if w.endswith(suffix)]
        words = [w for w in words if w and w.isascii() and w == w.lower() and "'" not in w and PRE_TOKEN.fullmatch(w)]
        proof = tok.encode_batch(words, add_special_tokens=False)
        whole = frozenset(w.encode() for w, e in zip(words, proof) if len(e.ids) == 1)
        _loaded[path] = (tok, whole)
    return _loaded[path]


def pre_tokens(unit: str) -> list[str] | None:
    """The pre-tokens of a blank-free unit, or None where only the library's
    own normaliser should decide (combining marks, rarer scripts, specials)."""
    if "<|" in unit or (not unit.isascii() and max(unit) >= "\u0250"):
        return None
    return PRE_TOKEN.findall(unit.lower())


def merged_counts(words: list[str], tok) -> list[int]:
    """Tokens of pre-tokens that are not whole, by the library's merges: many
    in one text, told apart by the number of the word each token belongs to."""
    out: list[int] = []
    for lo in range(0, len(words), 1000):
        part = words[lo:lo + 1000]
        got = np.bincount(np.array(tok.encode(" ".join(part), add_special_tokens=False).word_ids), minlength=len(part))
        out.extend(got.tolist())
    return out


def unit_count(text: str, tok, known: dict) -> int:
    """Tokens of one blank-free unit that the byte classes cannot split."""
    parts = pre_tokens(text)
    if parts is None:
        return len(tok.encode(text, add_special_tokens=False))
    missing = [w for w in dict.fromkeys(parts) if w not in known]
    if missing:
        known.update(zip(missing, merged_counts(missing, tok)))
    return sum(known[w] for w in parts)


def span_counts(spans: list[bytes], odd: np.ndarray, tok, whole: frozenset, known: dict) -> np.ndarray:
    """Tokens of each distinct span: 1 for whole tokens, merges for the rest.
    ``known`` keeps merged pre-tokens between batches and is bounded."""
    counts = np.ones(len(spans), dtype=np.int64)
    if len(known) > KNOWN_MOST:
        known.clear()
    todo: list[tuple[int, str]] = []
    rest: dict[str, None] = {}
    for i, (u, strange) in enumerate(zip(spans, odd.tolist())):
        if strange:
            counts[i] = unit_count(u.decode("utf-8", "replace"), tok, known)
        elif (w := u.lower()) not in whole:
            text = w.decode().lower()
            todo.append((i, text))
            if text not in known:
                rest[text] = None
    words = list(rest)
    known.update(zip(words, merged_counts(words, tok)))
    for i, w in todo:
        counts[i] = known[w]
    return counts


def pre_token_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and oddness of the pre-tokens of plain text: runs of
    letters, single digits, runs of other characters.  A unit holding an
    apostrophe, ``<|`` or anything beyond ASCII and the Latin letters of
    U+00C0 - U+017F is one odd span."""
    cls = CLASSES[buf]
    high = np.flatnonzero(buf >= 0x80)
    flag = np.flatnonzero(buf == 0x27)
    bar = np.flatnonzero(buf == 0x7C)
    bar = bar[bar > 0]
    bar = bar[buf[bar - 1] == 0x3C]
    if len(high):
        lead = high[(buf[high] >= 0xC3) & (buf[high] <= 0xC5)]
        lead = lead[lead + 1 < len(buf)]
        second = buf[lead + 1]
        plain = ~((buf[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))) & ~((buf[lead] == 0xC4) & (second == 0xB0))
        fine = np.zeros(len(buf), dtype=bool)
        fine[lead[plain]] = fine[lead[plain] + 1] = True
        flag = np.concatenate([flag, high[~fine[high]]])
    flag = np.concatenate([flag, bar])
    if len(flag):
        us, ue = S.word_spans(buf, off, S.NOT_BLANK)
        units = np.unique(np.searchsorted(us, flag, side="right") - 1)
        cls[S.ranges(us[units], ue[units] - us[units])] = ODD
    first = cls != 0
    first[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT)
    edges = off[1:-1]
    edges = edges[edges < len(buf)]
    first[edges] = cls[edges] != 0
    starts = np.flatnonzero(first)
    stop = np.append(starts[1:], len(buf))
    blank = np.flatnonzero(cls == 0)
    if len(blank):
        nxt = np.append(blank, len(buf))[np.searchsorted(blank, starts)]
        stop = np.minimum(stop, nxt)
    return starts, stop, cls[starts] == ODD


def batch_counts(col, tok, whole: frozenset, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text of an Arrow column."""
    buf, off = S.flat(col)
    tokens = np.zeros(len(off) - 1, dtype=np.int64)
    number: dict[tuple[bool, bytes], int] = {}      # distinct units of all chunks
    parts: list[tuple] = []
    for lo, hi in S.chunks(off):
        b, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        if len(b) == 0:
            continue
        st, en, odd = pre_token_spans(b, o)
        seen = S.FOLD[b]
        if odd.any():       # an odd span counts as it is written, and holds what no other one does
            at = S.ranges(st[odd], en[odd] - st[odd])
            seen[at] = b[at]
        at, inv = S.distinct_spans(seen, st, en)
        data = seen.tobytes()
        units = [number.setdefault((x, data[s:e]), len(number)) for x, s, e in zip(odd[at].tolist(), st[at].tolist(), en[at].tolist())]
        parts.append((lo, hi, np.array(units, dtype=np.int32), inv.astype(np.int32), S.per_document(st, o)))
    if not parts:
        return np.diff(off), tokens
    counts = span_counts([raw for _, raw in number], np.array([x for x, _ in number], dtype=bool), tok, whole, known)
    for lo, hi, units, inv, first in parts:
        c = np.zeros(len(inv) + 1, dtype=np.int64)
        np.cumsum(counts[units][inv], out=c[1:])
        tokens[lo:hi] = c[first[1:]] - c[first[:-1]]
    return np.diff(off), tokens


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", path: str | None = None,
                 limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, UTF-8 bytes, tokens, tokens over ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        tok, whole = load(S.tokenizer_file(vocabulary, path))
        known: dict[str, int] = {}
        for b in batches:
            n_bytes, n_tokens = batch_counts(b.column(1), tok, whole, known)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()),
                                   pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
