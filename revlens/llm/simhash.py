"""Operator 8: near-duplicates by SimHash and vantage-point trees.

Fingerprints: A-Z lower-cased, words between ASCII blanks, word shingles with
repeats, XXH64 (seed 42) of each shingle, majority of each bit.

Search: the distinct fingerprints are dealt to the leaves of a vantage-point
tree whose vantage points come from a sample of at most ``SAMPLE_MOST``
fingerprints (they decide only the dealing, never the result).  A fingerprint
is a point of its own leaf and a query of every leaf that the triangle bounds
cannot exclude, so the search is exact.  Inside a leaf a second tree answers
the queries.  A leaf sends on the links of its local components, not all
pairs; the links are joined into components over all fingerprints.

Equal fingerprints are one point.  Each document gets the class of its
fingerprint; the class id is the smallest doc_id in it.

Cases: NULL and blank texts have the fingerprint zero, which links like any
other; rows that repeat a doc_id stay separate rows; NULL ids are never the
class id unless all ids of a class are NULL; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import textspans as S
from revlens.llm.components import components, written
from revlens.plans.session import shuffle_partitions

SHINGLE = 3
MAX_BITS = 2
SAMPLE_MOST = 8192
LEAF_POINTS = 8192
SMALL_LEAF = 256
SEED = 42
HOT_PARTS = 8


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    cut = np.concatenate([[0], np.cumsum(size)])
    digest = xxhash.xxh64_intdigest
    n, bits = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 100_000):
        hi = min(lo + 100_000, n)
        h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(cut[lo:hi].tolist(), (cut[lo + shingle:hi + shingle] - 1).tolist())),
                        np.uint64, hi - lo)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)
                              for x in col.cast(pa.large_binary())), np.uint64, len(col))
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


class VPTree:
    """Vantage-point tree over fingerprints: at each node the points within
    the median distance of the vantage point go left, the others right."""

    def __init__(self, points: np.ndarray, leaf: int, depth_most: int = 60):
        self.nodes: list[tuple] = []    # (vantage, radius, left, right) or (None, leaf number, first, last)
        self.order = np.arange(len(points))
        self.points, self.leaves = points, 0
        self._build(0, len(points), leaf, depth_most)

    def _build(self, lo: int, hi: int, leaf: int, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        at = self.order[lo:hi]
        radius = -1
        if hi - lo > leaf and depth:
            vantage = self.points[at[(hi - lo) * 7 // 11]]
            d = np.bitwise_count(self.points[at] ^ vantage)
            radius = int(np.median(d))
            if not (d > radius).any():
                radius = int(d.max()) - 1       # the furthest go right; -1: all at one distance, no split
        if radius < 0:
            self.nodes[me] = (None, self.leaves, lo, hi)
            self.leaves += 1
            return me
        by = np.argsort(d > radius, kind="stable")
        self.order[lo:hi] = at[by]
        mid = lo + int((d <= radius).sum())
        left = self._build(lo, mid, leaf, depth - 1)
        right = self._build(mid, hi, leaf, depth - 1)
        self.nodes[me] = (vantage, radius, left, right)
        return me

    def visit(self, queries: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
        """(leaf, query numbers, first, last) of the leaves that the triangle
        bounds do not exclude; reach 0 gives each query its own leaf."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            vantage, radius, left, right = self.nodes[node]
            if vantage is None:
                yield radius, q, left, right
                continue
            d = np.bitwise_count(queries[q] ^ vantage).astype(np.int16)
            stack.append((left, q[d - reach <= radius]))
            stack.append((right, q[d + reach > radius]))


def links_within(points: np.ndarray, queries: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, point number) of all pairs of different values within
    ``bits``, in blocks."""
    tree = VPTree(points, SMALL_LEAF)
    for _, q, lo, hi in tree.visit(queries, bits):
        own = tree.order[lo:hi]
        step = max(1, (1 << 20) // max(1, len(own)))
        for a in range(0, len(q), step):
            part = q[a:a + step]
            for b in range(0, len(own), 1 << 16):
                at = own[b:b + (1 << 16)]
                x, y = np.nonzero(np.bitwise_count(queries[part][:, None] ^ points[at][None, :]) <= bits)
                x, y = part[x], at[y]
                other = queries[x] != points[y]
                yield x[other], y[other]


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of nodes, by pointer jumping."""
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def local_stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of n nodes after joining all pairs (the root is the
    smallest node number of its component)."""
    parent = np.arange(n)
    for x, y in pairs:
        while len(x):
            x, y = find(parent, x), find(parent, y)
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = parent[parent]
    return find(parent, np.arange(n))


def fingerprint_links(values: DataFrame, bits: int = MAX_BITS, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints (column fp) within
    ``bits`` into the same components."""
    n = values.count()
    if n == 0:
        return values.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    sample = np.array([r[0] for r in values.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_MOST).collect()], dtype=np.int64)
    # at least 16 leaves; the sample's leaves stand for leaf_points points each
    leaf = max(1, min(len(sample) // 16, int(len(sample) * leaf_points / n)))
    nodes = VPTree(sample.view(np.uint64), leaf)
    nodes.points = nodes.order = None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            home = np.empty(len(fp), dtype=np.int64)
            for leaf_no, q, _, _ in nodes.visit(fp.view(np.uint64), 0):
                home[q] = leaf_no
            for leaf_no, q, _, _ in nodes.visit(fp.view(np.uint64), bits):
                yield pa.record_batch([pa.array(np.full(len(q), leaf_no)), pa.array(fp[q]), pa.array(home[q] == leaf_no)],
                                      names=["leaf", "fp", "home"])

    def match(table: pa.Table) -> pa.Table:
        fp = np.unique(table["fp"].to_numpy().view(np.uint64))
        home = np.isin(fp, table["fp"].to_numpy().view(np.uint64)[table["home"].to_numpy(zero_copy_only=False)])
        at = np.flatnonzero(home)
        root = local_stars(len(fp), ((q, at[p]) for q, p in links_within(fp[home], fp, bits)))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"u": fp[moved].view(np.int64), "v": fp[root[moved]].view(np.int64)})

    dealt = values.select("fp").mapInArrow(deal, "leaf bigint, fp bigint, home boolean")
    return dealt.groupBy("leaf").applyInArrow(match, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document."""
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    comp = components(fingerprint_links(classes, bits))
    low = (classes.join(comp, classes["fp"] == comp["node"]).groupBy("component").agg(F.min("first_id").alias("low")))
    moved = comp.join(low, "component").select(F.col("node").alias("fp"), "low")
    label = classes.join(moved, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id"), "n")
    # fingerprints of very many documents would each fill a task of the join: there are
    # fewer of them than HOT_PARTS x partitions, whatever the input, so they are broadcast
    parts = HOT_PARTS * shuffle_partitions(docs.sparkSession)
    limit = int(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // parts + 1
    hot = F.broadcast(label.where(F.col("n") > limit).drop("n"))
    labelled = fps.join(hot, "fp").unionByName(fps.join(hot, "fp", "left_anti").join(label.where(F.col("n") <= limit).drop("n"), "fp"))
    return labelled.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which one of each class stays: the row of
    the smallest doc_id (NULL last); of rows that repeat it, that of the
    smallest fingerprint, and of equal rows one."""
    names = docs.columns
    at = [names.index(id_col), names.index(text_col)]
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)
                              for x in b.column(at[1]).cast(pa.large_binary())), np.uint64, b.num_rows)
            yield pa.record_batch([*b.columns, pa.array(fp.view(np.int64))], names=[*names, "_fp"])

    marked = written(docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_fp", LongType())])), "fingerprinted")
    keys = marked.groupBy(F.col("_fp").alias("fp"), F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    keys = written(keys, "keys")        # without the texts
    classes = written(keys.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    comp = components(fingerprint_links(classes, bits))
    label = classes.join(comp, classes["fp"] == comp["node"], "left").select(F.coalesce("component", "fp").alias("component"), "fp", "first_id")
    first = label.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("_id"),
                                                          F.col("fp").alias("_f"))).alias("k"))
    kept = first.select("k._id", "k._f")
    # how many rows have a kept key: nearly always one, and that row is kept as it is
    counted = (keys.join(kept, keys["id"].eqNullSafe(kept["_id"]) & (keys["fp"] == kept["_f"]))
               .select(F.col("id").alias("_id"), F.col("fp").alias("_f"), F.col("n").alias("_n")))
    rows = marked.join(counted, marked[id_col].eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("_f")))
    # of rows that repeat a kept id with an equal fingerprint the smallest text stays
    once = rows.where("_n > 1").groupBy(id_col, "_fp").agg(F.min_by(F.struct(*names), F.struct(F.col(text_col), F.xxhash64(*names))).alias("r"))
    return rows.where("_n = 1").select(*names).unionByName(once.select(*[F.col(f"r.`{c}`").alias(c) for c in names]))
