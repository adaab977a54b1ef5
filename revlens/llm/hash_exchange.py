"""Exchange of packed hash columns between document chunks and hash buckets.

Documents are grouped into chunks of a few megabytes.  Each chunk sends the
distinct 64-bit hashes it holds, sorted and packed, to the bucket that owns
their leading bits; the bucket joins the columns of all chunks and answers
each chunk in the order in which it asked.  A row stands for (chunk, bucket),
so the shuffles carry seven bytes for each distinct hash of a chunk and no
row is larger than its chunk.  A hash common to all chunks costs its bucket
one entry a chunk: nothing is gathered by hash value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_TEXT = 4 << 20
MIN_BUCKETS = 256
#: Hashes in one bucket, about (56 bytes of working memory each).
BUCKET_HASHES = 1 << 20


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts (one scan, one row)."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("bigint")), F.lit(0))).first()[0])


def sizes(total: int) -> tuple[int, int]:
    """(chunks, buckets as a power of two) for that many bytes of text."""
    chunks = max(16, -(-total // CHUNK_TEXT))
    buckets = MIN_BUCKETS
    while buckets * BUCKET_HASHES * 6 < total:
        buckets *= 2
    return chunks, buckets


def pack(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, from, to, blob) of each bucket that sorted distinct hashes touch."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    owner = (hashes >> shift).astype(np.int64)
    cut = np.flatnonzero(np.diff(owner)) + 1
    lows = np.concatenate([[0], cut]) if len(owner) else []
    highs = np.append(cut, len(owner))
    for lo, hi in zip(lows, highs):
        yield int(owner[lo]), int(lo), int(hi), np.ascontiguousarray(
            hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack(bucket: int, blob: bytes, buckets: int) -> np.ndarray:
    """The hashes of a blob of that bucket."""
    low = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 7)
    out = np.empty((len(low), 8), dtype=np.uint8)
    out[:, :7] = low
    out[:, 7] = bucket >> (buckets.bit_length() - 9)
    return out.view("<u8").ravel()


def places(hashes: np.ndarray, buckets: int) -> dict[int, tuple[int, int]]:
    """Where each bucket's answer belongs among sorted distinct hashes."""
    return {b: (lo, hi) for b, lo, hi, _ in pack(hashes, buckets)}
