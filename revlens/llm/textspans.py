"""Vectorised word spans and Rabin-Karp hashes over Arrow text columns.

Used inside Arrow batches: one batch of texts is seen as one byte buffer with
document offsets; words are byte ranges.  A range is hashed by a random
multiplier for each place (no text collides by its structure, unlike with
powers of one base modulo 2**64), a window of words by a polynomial modulo the
prime 2**61 - 1.  Where equal ranges of one batch stand for each other, their
bytes are compared (``distinct_spans``).  Nothing here keeps state between
batches, and the working memory is a small multiple of ``CHUNK_BYTES`` (or of
the longest single text, where that is larger).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASE = 0xD1342543DE82EF95 | 1


def byte_values(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit values (SplitMix64 of the seed)."""
    out, x = [], seed
    for _ in range(256):
        x = (x + 0x9E3779B97F4A7C15) & _M64
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


BYTE_VALUES = byte_values(42)
#: The same values with A-Z hashed as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

#: Byte classes: everything but ASCII blanks; and digits, letters and bytes of non-ASCII characters.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Bytes with A-Z as a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_multipliers = np.zeros(0, dtype=np.uint64)


def multipliers(n: int) -> np.ndarray:
    """n pseudo-random odd 64-bit values, one a place (SplitMix64)."""
    global _multipliers
    if n <= len(_multipliers):
        return _multipliers
    size = max(n, 4096)
    with np.errstate(over="ignore"):
        x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(BASE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))) | np.uint64(1)
    if size <= CHUNK_BYTES:
        _multipliers = x
    return x


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; NULL is the empty text."""
    arr = as_array(col)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``most`` bytes (or one document)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``keep`` bytes inside documents."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = keep[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each byte range; the ranges ascend without overlap."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    longest = max(1, int((ends - starts).max()))
    heads = np.concatenate([[0], starts])
    place = np.arange(len(buf), dtype=np.int64) - np.repeat(heads, np.diff(np.append(heads, len(buf))))
    np.minimum(place, longest - 1, out=place)       # bytes behind a range do not count
    v = values[buf]
    v *= multipliers(longest)[place]
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(v, out=sums[1:])
    return mix(sums[ends] - sums[starts])


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each range of one buffer holds the bytes of its partner."""
    size = ends - starts
    same = size == other_ends - other_starts
    n = np.where(same, size, 0)
    if n.sum():
        differ = buf[ranges(starts, n)] != other[ranges(other_starts, n)]
        if differ.any():
            bad = np.concatenate([[0], np.cumsum(differ)])
            cut = np.concatenate([[0], np.cumsum(n)])
            same &= bad[cut[1:]] == bad[cut[:-1]]
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first range of each distinct one, number of each range): found by
    hash, then every range is compared with the first of its number.  ``buf``
    is as it is to be compared (folded or not)."""
    h = span_hashes(buf, starts, ends) if hashes is None else hashes
    _, at, inv = np.unique(h, return_index=True, return_inverse=True)
    first = at[inv]
    if same_spans(buf, starts, ends, buf, starts[first], ends[first]).all():
        return at, inv
    data, number, at = buf.tobytes(), {}, []        # a collision: by the bytes themselves
    inv = np.empty(len(starts), dtype=np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        inv[i] = k = number.setdefault(data[a:b], len(at))
        if k == len(at):
            at.append(i)
    return np.array(at, dtype=np.int64), inv


PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, c: int) -> np.ndarray:
    """a * c modulo 2**61 - 1, both below it."""
    hi, lo = a >> np.uint64(31), a & np.uint64((1 << 31) - 1)
    c_hi, c_lo = np.uint64(c >> 31), np.uint64(c & ((1 << 31) - 1))
    mid = hi * c_lo + lo * c_hi
    total = np.uint64(2) * (hi * c_hi) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + lo * c_lo
    return _reduced(total)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash (base ``WINDOW_BASE``, modulo 2**61 - 1) of every
    ``size`` consecutive word hashes, joined from windows of 1, 2, 4 ... words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = WINDOW_BASE % PRIME

    def joined(left: np.ndarray, k: int, right: np.ndarray, j: int) -> np.ndarray:
        m = len(right) - k
        return _reduced(_times(left[:m], pow(base, j, PRIME)) + right[k:])

    part, k, out, have = _reduced(words), 1, None, 0
    while k <= size:
        if size & k:
            out, have = (part, k) if out is None else (joined(out, have, part, k), have + k)
        if 2 * k <= size:
            part = joined(part, k, part, k)
        k *= 2
    return mix(out[:n].copy())


def per_document(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First word of each document, as n + 1 positions in ``starts``."""
    return np.searchsorted(starts, offsets)


def ranges(lo: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... (counts[0] values), then the same for each next one."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(lo - (ends - counts), counts)


def tokenizer_file(name: str, path: str | None = None) -> str:
    """Place of a public vocabulary file; ``path`` overrides the installed one."""
    if path:
        return os.path.join(path, name) if os.path.isdir(path) else path
    import public_tokenizers

    return public_tokenizers.path(name)
