"""Operator 11: fill-in-middle transformation with Fenwick-indexed cuts.

A text is a row of units (a word with the blanks before it; blanks that end
the text are a unit).  It is cut after two random numbers of units, and its
three pieces are written out as PSM (prefix, suffix, middle), as SPM (suffix,
prefix, middle) or, for a share of the texts, left as they are.

Cutting: the UTF-8 bytes of a text are seen as blocks of ``BLOCK`` bytes.  Two
Fenwick trees hold the units that end in each block and the code points that
start in it.  To cut after k units, a descent by powers of two walks down the
tree of units to the block where the k-th unit ends and adds up the code points
passed on the way; only that block is then read again to find the boundary.
The counts are taken in slabs of ``SLAB`` bytes, so a very long text costs two
numbers per block beside its own bytes.

The draws are 32-bit groups of sha256 of the seed and the id: h1 and h2 the
cuts, h3 plain or not, h4 the form.

Cases: a NULL text is the empty text; empty texts, and texts that hold a marker
themselves, stay plain (their output is the text); a blank text is one unit; a
NULL id draws as an empty id; rows that repeat an id are cut by the same draws,
each in its own text; both cuts may be equal (an empty middle) or at either
end; very long texts are cut whole; empty tables give empty results; other
columns, clashing names included, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import textspans as S

BLOCK = 2048
SLAB = 1 << 20
SEED = 42
PLAIN_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)


class Fenwick:
    """Prefix sums of counts per block, two at once: a unit tree that is
    descended and a code-point tree that is summed along."""

    def __init__(self, units: np.ndarray, chars: np.ndarray):
        self.n = len(units)
        self.units, self.chars = self._tree(units), self._tree(chars)

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        """tree[i] sums the i & -i counts that end with count i (from 1)."""
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        i = np.arange(len(upto))
        return (upto - upto[i - (i & -i)]).tolist()

    def descend(self, k: int) -> tuple[int, int, int]:
        """(block, units, code points) before the block in which the k-th unit
        ends, k from 1 to the number of units."""
        at, units, chars, step = 0, 0, 0, 1 << max(self.n.bit_length() - 1, 0)
        while step:
            to = at + step
            if to <= self.n and units + self.units[to] < k:
                at, units, chars = to, units + self.units[to], chars + self.chars[to]
            step >>= 1
        return at, units, chars


class Units:
    """The units of one text, by block."""

    def __init__(self, buf: np.ndarray, block: int = BLOCK):
        self.buf, self.block = buf, block
        n, counts, chars = -(-len(buf) // block), [], []
        slab = max(1, SLAB // block) * block
        for lo in range(0, len(buf), slab):
            ends = self._ends(lo, min(lo + slab, len(buf)))
            starts = (buf[lo:lo + slab] & 0xC0) != 0x80
            at = np.arange(0, len(ends), block)
            counts.append(np.add.reduceat(ends, at, dtype=np.int64))
            chars.append(np.add.reduceat(starts, at, dtype=np.int64))
        none = [np.zeros(0, np.int64)]
        counts, chars = np.concatenate(counts or none), np.concatenate(chars or none)
        self.n_units, self.n_chars = int(counts.sum()), int(chars.sum())
        self.tree = Fenwick(counts, chars)
        assert self.tree.n == n

    def _ends(self, lo: int, hi: int) -> np.ndarray:
        """Whether a unit ends with each byte of the range: the last byte of a
        word, and the last byte of the text."""
        word = S.NOT_BLANK[self.buf[lo:hi]]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        if hi == len(self.buf):
            ends[-1] = True
        else:
            ends[-1] &= not S.NOT_BLANK[self.buf[hi]]
        return ends

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which the first k units end."""
        if k == 0:
            return 0, 0
        block, units, chars = self.tree.descend(k)
        lo = block * self.block
        hi = min(lo + self.block, len(self.buf))
        to = lo + int(np.flatnonzero(self._ends(lo, hi))[k - units - 1]) + 1
        return to, chars + int(np.count_nonzero((self.buf[lo:to] & 0xC0) != 0x80))


def draws(doc_id, seed: int = SEED) -> tuple[int, int, int, int]:
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(h[i:i + 4], "big") for i in (0, 4, 8, 12))


def cut_text(doc_id, text: bytes, seed: int = SEED, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of prefix, of middle, output) of one text."""
    u = Units(np.frombuffer(text, dtype=np.uint8), block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= PLAIN_PERCENT or any(m.encode() in text for m in MARKERS):
        return u.n_units, "plain", None, None, text
    low, high = sorted((h1 % (u.n_units + 1), h2 % (u.n_units + 1)))
    (a, a_chars), (b, b_chars) = u.cut(low), u.cut(high)
    p, s, m = (x.encode() for x in MARKERS)
    if h4 % 100 < SPM_PERCENT:
        form, out = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, out = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return u.n_units, form, a_chars, b_chars - a_chars, out


def transform(docs: DataFrame, seed: int = SEED, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            _, offsets = S.flat(b.column(1))
            for lo, hi in S.chunks(offsets):
                part = b.column(1).slice(lo, hi - lo).cast(pa.large_binary())
                rows = [cut_text(i, x.as_buffer().to_pybytes() if x.is_valid else b"", seed, block) for i, x in zip(ids[lo:hi], part)]
                n, form, pre, mid, out = zip(*rows)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(form), pa.array(pre, pa.int64()),
                                       pa.array(mid, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                                      names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
            .mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"))


def restore(output: Column, form: Column) -> Column:
    """The text back from output and form alone.  A text that was cut holds no
    marker, and no marker can begin inside another, so each is found once."""

    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        head, rest = F.substring_index(output, second, 1), F.substring_index(output, second, -1)
        return F.substring_index(head, first, -1), F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    p, s, m = pieces(PREFIX, SUFFIX)
    s2, p2, m2 = pieces(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def brute_force(rows: Sequence[tuple]) -> list[tuple]:
    """The digest of (doc_id, text) by the unit pattern over code points."""
    import re

    out = []
    for i, text in rows:
        text = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        h = hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        made = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((i, len(units), form, *((None, None) if form == "plain" else (len(pre), len(mid))), sha(made), sha(text)))
    return out
