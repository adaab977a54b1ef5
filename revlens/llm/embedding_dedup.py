"""Operator 7: near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors are one point with a number of copies.
2. Centroids from a sample of at most ``SAMPLE_MOST`` points deal every point
   to its ``OVERLAP`` nearest clusters: overlapping shards.  A shard of more
   than ``SHARD_MOST`` points is dealt into parts, and its queries into blocks.
3. Each part builds a graph: near and random candidates, robust pruning
   (alpha), reverse edges.  The adjacency lists of a point are united.
4. Every point is a query in its home shard, against all its parts: greedy
   search from medoids, then expansion of everything within the range.  Each
   pair found is verified by its cosine in double precision.
5. Parts send on counts and the links of local components, never all pairs.
6. Recall is audited against brute force over all vectors: the mean, over
   sampled points that have a link, of the share of their links that was found,
   so a large group of copies counts no more than a pair.  More points are drawn
   until ``AUDIT_LINKED`` have a link.  Below ``RECALL_LEAST`` the search is
   repeated wider; if it stays below ``RECALL_BOUND``, each point is compared with
   all points of every shard that the triangle bound of angles does not exclude.
   The reported recall is NULL where no sampled point has a link.
7. Vectors are searched so by length.  Beyond the ``LENGTHS`` most frequent
   lengths, those of at most ``SMALL`` points are compared in full, together in
   one job, so any number of lengths is handled.

Cases: vectors that are NULL, empty, zero or hold NULL or non-finite numbers
link with nothing (0 links, their own component, kept); vectors of different
lengths do not link; rows that repeat a vec_id are separate vectors of one id
(each counts as a copy; the id is still reported once a row); NULL ids are
left as they are and link with nothing; empty tables give empty results; other
columns, labels too, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.components import components, written
from revlens.llm.simhash import local_stars

THRESHOLD = 0.95
SLACK = 0.05
SAMPLE_MOST = 8192
SHARD_POINTS = 1500
SHARDS_LEAST, SHARDS_MOST = 16, 4096
SHARD_MOST = 6000
OVERLAP = 2
DEGREE = 16
ALPHA = 1.2
NEAR, FAR = 40, 16
BEAM = 32
STEP = 4
MEDOIDS = 16
BLOCK = 256
AUDIT_FIRST, AUDIT_MOST, AUDIT_LINKED = 512, 8192, 64
RECALL_LEAST, RECALL_BOUND = 0.95, 0.9
LENGTHS, SMALL = 64, 2048

POINT = "shard int, home boolean, rep bigint, copies bigint, vec array<float>"
FOUND = "rep bigint, found bigint, root bigint"


def _matrix(col) -> np.ndarray:
    """Unit vectors in double precision from a list column of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300) if n else 1.0   # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(7)
    c = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def prune(x: np.ndarray, own: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of candidate lists (rows of point numbers, -1 for none):
    the nearest candidate is kept, those it covers by a factor alpha go."""
    out = np.full((len(own), degree), -1, dtype=np.int64)
    for lo in range(0, len(own), 1024):
        q, c = x[own[lo:lo + 1024]], cand[lo:lo + 1024]
        far = 1.0 - np.einsum("ij,ikj->ik", q, x[c])
        far[(c < 0) | (c == own[lo:lo + 1024, None])] = np.inf
        row = np.arange(len(c))
        for k in range(degree):
            best = far.argmin(axis=1)
            live = np.isfinite(far[row, best])
            if not live.any():
                break
            out[lo:lo + 1024][live, k] = c[row, best][live]
            between = 1.0 - np.einsum("ij,ikj->ik", x[c[row, best]], x[c])
            gone = (alpha * alpha * between <= far) & live[:, None]
            far[gone] = np.inf
            far[row[live], best[live]] = np.inf
    return out


def build_graph(x: np.ndarray) -> np.ndarray:
    """Adjacency rows (-1 padded) of a robust-pruned graph over unit vectors."""
    n = len(x)
    rng = np.random.default_rng(n)
    near = min(NEAR, n - 1)
    cand = np.full((n, near + FAR), -1, dtype=np.int64)
    for lo in range(0, n if near > 0 else 0, 512):
        s = x[lo:lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2.0
        cand[lo:lo + 512, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    cand[:, near:] = rng.integers(0, n, (n, FAR))
    every = np.arange(n)
    out = prune(x, every, cand, DEGREE, ALPHA)
    # edges back, pruned again where there are too many
    a, k = np.nonzero(out >= 0)
    src, dst = np.concatenate([a, out[a, k]]), np.concatenate([out[a, k], a])
    pair = np.unique(src * n + dst)
    src, dst = pair // n, pair % n
    first = np.searchsorted(src, np.arange(n + 1))
    size = np.diff(first)
    width = int(size.max()) if n else 0
    both = np.full((n, max(width, 1)), -1, dtype=np.int64)
    both[src, np.arange(len(src)) - first[src]] = dst
    if width > 2 * DEGREE:
        # far more edges come in at hubs than go out: keep the pruned list and the nearest of the rest
        hub = np.flatnonzero(size > 2 * DEGREE)
        for h in hub.tolist():
            row = both[h][both[h] >= 0]
            rest = np.setdiff1d(row, out[h])
            keep = np.concatenate([out[h][out[h] >= 0], rest[np.argsort(-(x[rest] @ x[h]), kind="stable")]])[:2 * DEGREE]
            both[h] = -1
            both[h, :len(keep)] = keep
        both = both[:, :2 * DEGREE]
    return both


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """Points nearest to the centres of k clusters."""
    c = centroids(x[:2048] if len(x) > 2048 else x, min(k, len(x)), 4)
    return np.unique((x @ c.T).argmax(axis=0))


def search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, own: np.ndarray, beam: int, reach: float) -> Iterator[tuple]:
    """(query, point) pairs of cosine >= ``reach`` found from the medoids (and
    a query's own node, -1 if it has none), in blocks of queries."""
    entry = medoids(x)
    for lo in range(0, len(queries), BLOCK):
        yield from _search_block(x, graph, queries[lo:lo + BLOCK], own[lo:lo + BLOCK], lo, entry, beam, reach)


def _search_block(x, graph, q, own, base, entry, beam, reach):
    m, n, row = len(q), len(x), np.arange(len(q))[:, None]
    visited = np.zeros((m, n + 1), dtype=bool)      # column n stands for none
    ids = np.concatenate([np.tile(entry, (m, 1)), np.where(own < 0, n, own)[:, None]], axis=1)
    cand = np.full((m, beam), n, dtype=np.int64)
    sim = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), dtype=bool)
    border_q, border_p = [], []
    padded = np.concatenate([x, np.zeros((1, x.shape[1]))])
    links = np.concatenate([np.where(graph < 0, n, graph), np.full((1, graph.shape[1]), n)])
    while True:
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = n
        ids[visited[row, ids]] = n
        visited[row, ids] = True
        visited[:, n] = False
        s = np.einsum("ikj,ij->ik", padded[ids], q)
        s[ids == n] = -np.inf
        a, b = np.nonzero(s >= reach - SLACK)
        border_q.append(a)
        border_p.append(ids[a, b])
        every = np.concatenate([cand, ids], axis=1)
        sims = np.concatenate([sim, s], axis=1)
        ended = np.concatenate([done, ids == n], axis=1)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        cand, sim, done = np.take_along_axis(every, top, 1), np.take_along_axis(sims, top, 1), np.take_along_axis(ended, top, 1)
        todo = np.argsort(done, axis=1, kind="stable")[:, :STEP]
        if done.all():
            break
        node = np.where(np.take_along_axis(done, todo, 1), n, np.take_along_axis(cand, todo, 1))
        np.put_along_axis(done, todo, True, 1)
        ids = links[node].reshape(m, -1)
    bq, bp = np.concatenate(border_q), np.concatenate(border_p)
    while len(bq):
        fresh_q, fresh_p = [], []
        for lo in range(0, len(bq), 20_000):
            a, b = bq[lo:lo + 20_000], bp[lo:lo + 20_000]
            inside = (padded[b] * q[a]).sum(axis=1) >= reach
            if inside.any():
                yield base + a[inside], b[inside]
            nxt = links[b]
            key = np.repeat(a, nxt.shape[1]) * (n + 1) + nxt.ravel()
            key = np.unique(key)
            a, b = key // (n + 1), key % (n + 1)
            new = (b < n) & ~visited[a, b]
            a, b = a[new], b[new]
            visited[a, b] = True
            for k in range(0, len(a), 50_000):
                close = (padded[b[k:k + 50_000]] * q[a[k:k + 50_000]]).sum(axis=1) >= reach - SLACK
                fresh_q.append(a[k:k + 50_000][close])
                fresh_p.append(b[k:k + 50_000][close])
        bq = np.concatenate(fresh_q) if fresh_q else np.zeros(0, np.int64)
        bp = np.concatenate(fresh_p) if fresh_p else np.zeros(0, np.int64)


def _valid(v: str = "vec"):
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & good & F.exists(v, lambda e: e != 0), F.lit(False))


def _links(points: DataFrame, n: int, reach: float, overlap: int, beam: int) -> DataFrame:
    """(rep, found, root) of all points of one length: links found for queries,
    and the root of each point's local component."""
    sample = _matrix(pa.array([r[0] for r in points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_MOST).select("vec").collect()],
                              pa.list_(pa.float32())))
    k = min(max(SHARDS_LEAST, min(SHARDS_MOST, -(-n // SHARD_POINTS))), len(sample))
    centre = centroids(sample, k)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                s = _matrix(part.column(2)) @ centre.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :min(overlap, k)]
                for j in range(near.shape[1]):
                    yield pa.record_batch([pa.array(near[:, j], pa.int32()), pa.array(np.full(len(near), j == 0)), *part.columns],
                                          names=["shard", "home", "rep", "copies", "vec"])

    dealt = written(points.mapInArrow(deal, POINT), "shards")
    size = {r["shard"]: r["n"] for r in dealt.groupBy("shard").agg(F.count("*").alias("n")).collect()}   # at most SHARDS_MOST rows
    parts = F.element_at(F.create_map(*[F.lit(x) for s, c in sorted(size.items()) for x in (s, -(-c // SHARD_MOST))]), F.col("shard"))
    d = dealt.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))

    def build(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        graph = build_graph(_matrix(table["vec"]))
        rows = [rep[g[g >= 0]].tolist() for g in graph]
        return pa.table({"rep": table["rep"], "near": pa.array(rows, pa.list_(pa.int64()))})

    near = d.groupBy("shard", "part").applyInArrow(build, "rep bigint, near array<bigint>")
    united = near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    block = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts"))
    node = d.join(united, "rep").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    query = d.where("home").select(F.col("rep").alias("q_rep"), F.col("vec").alias("q_vec"), F.col("shard").alias("q_shard"),
                                   block.alias("q_block"),
                                   F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("q_part"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        rep, ask = left["rep"].to_numpy(), right["q_rep"].to_numpy()
        if not len(rep) or not len(ask):
            return pa.table({"rep": right["q_rep"], "found": pa.array(np.zeros(len(ask), np.int64)), "root": right["q_rep"]})
        by = np.argsort(rep)
        left, rep = left.take(by), rep[by]
        x, copies = _matrix(left["vec"]), left["copies"].to_numpy()
        lists = left["near"].combine_chunks()
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(rep, flat), len(rep) - 1)
        at = np.where(rep[at] == flat, at, -1)
        off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        width = max(1, int(np.diff(off).max()))
        graph = np.full((len(rep), width), -1, dtype=np.int64)
        owner = np.repeat(np.arange(len(rep)), np.diff(off))
        graph[owner, np.arange(len(at)) - off[owner]] = at
        q = _matrix(right["q_vec"])
        own = np.minimum(np.searchsorted(rep, ask), len(rep) - 1)
        own = np.where(rep[own] == ask, own, -1)
        every = np.unique(np.concatenate([rep, ask]))
        found = np.zeros(len(ask), dtype=np.int64)

        def counted():
            for a, b in search(x, graph, q, own, beam, reach):
                other = rep[b] != ask[a]
                a, b = a[other], b[other]
                np.add.at(found, a, copies[b])
                yield np.searchsorted(every, ask[a]), np.searchsorted(every, rep[b])

        root = local_stars(len(every), counted())
        total = np.zeros(len(every), dtype=np.int64)
        total[np.searchsorted(every, ask)] = found
        return pa.table({"rep": pa.array(every), "found": pa.array(total), "root": pa.array(every[root])})

    return node.groupBy("shard", "part", "block").cogroup(query.groupBy("q_shard", "q_part", "q_block")).applyInArrow(match, FOUND)


def audit(points: DataFrame, found: DataFrame, reach: float) -> tuple[float | None, bool]:
    """Mean share of the true links found, over the sampled points that have
    one (None: none has), and whether the sample was all points."""
    most = AUDIT_FIRST
    while True:
        rows = points.orderBy(F.xxhash64("rep", F.lit(2)), "rep").limit(most).collect()
        if not rows:
            return None, True
        ids, q = np.array([r["rep"] for r in rows]), _matrix(pa.array([r["vec"] for r in rows], pa.list_(pa.float32())))
        step = max(64, (1 << 21) // len(ids))

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(ids), dtype=np.int64)
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    p = b.slice(lo, step)
                    near = (q @ _matrix(p.column(2)).T >= reach) & (ids[:, None] != p.column(0).to_numpy()[None, :])
                    total += near @ p.column(1).to_numpy()
            yield pa.record_batch([pa.array(ids), pa.array(total)], names=["rep", "n"])

        true = points.mapInArrow(brute, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0")
        got = found.groupBy("rep").agg(F.sum("found").alias("f"))
        linked, share = true.join(got, "rep", "left").agg(F.count("*"), F.avg(F.least("n", F.coalesce("f", F.lit(0))) / F.col("n"))).first()
        if linked >= AUDIT_LINKED or len(rows) < most or most >= AUDIT_MOST:
            return share, len(rows) < most
        most *= 4


def _compared(x: np.ndarray, rep: np.ndarray, copies: np.ndarray, q: np.ndarray, ask: np.ndarray, reach: float) -> pa.Table:
    """Rows of ``FOUND`` of all pairs of points and queries, by products of blocks."""
    every = np.unique(np.concatenate([rep, ask]))
    found = np.zeros(len(ask), dtype=np.int64)

    def pairs():
        for lo in range(0, len(q), BLOCK):
            a, b = np.nonzero(q[lo:lo + BLOCK] @ x.T >= reach)
            a += lo
            other = rep[b] != ask[a]
            a, b = a[other], b[other]
            np.add.at(found, a, copies[b])
            yield np.searchsorted(every, ask[a]), np.searchsorted(every, rep[b])

    root = local_stars(len(every), pairs())
    total = np.zeros(len(every), dtype=np.int64)
    total[np.searchsorted(every, ask)] = found
    return pa.table({"rep": pa.array(every), "found": pa.array(total), "root": pa.array(every[root])})


def _links_of_small(points: DataFrame, reach: float) -> DataFrame:
    """All links among points of one length, for lengths of few points."""

    def match(table: pa.Table) -> pa.Table:
        x, ids = _matrix(table["vec"]), table["rep"].to_numpy()
        return _compared(x, ids, table["copies"].to_numpy(), x, ids, reach)

    return points.withColumn("d", F.size("vec")).groupBy("d").applyInArrow(match, FOUND)


def _links_exact(points: DataFrame, n: int, reach: float) -> DataFrame:
    """All links: a point is compared with every shard that may hold a vector
    within the angle of ``reach``.  A shard's angle is the largest of its
    points to its centroid; the bound is the triangle inequality of angles."""
    sample = _matrix(pa.array([r[0] for r in points.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_MOST).select("vec").collect()],
                              pa.list_(pa.float32())))
    k = min(max(SHARDS_LEAST, min(SHARDS_MOST, -(-n // SHARD_POINTS))), len(sample))
    centre = centroids(sample, k)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                p = b.slice(lo, 2000)
                s = np.clip(_matrix(p.column(2)) @ centre.T, -1, 1)
                at = s.argmax(axis=1)
                yield pa.record_batch([pa.array(at, pa.int32()), pa.array(np.arccos(s[np.arange(len(at)), at])), *p.columns],
                                      names=["shard", "angle", "rep", "copies", "vec"])

    homes = written(points.mapInArrow(home, "shard int, angle double, rep bigint, copies bigint, vec array<float>"), "homes")
    sizes = homes.groupBy("shard").agg(F.max("angle").alias("a"), F.count("*").alias("n")).collect()     # at most SHARDS_MOST rows
    radius = np.full(k, -np.inf)
    parts = np.ones(k, dtype=np.int64)
    for r in sizes:
        radius[r["shard"]], parts[r["shard"]] = r["a"], -(-r["n"] // SHARD_MOST)
    limit = radius + np.arccos(min(1.0, reach)) + 1e-6

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                row, shard = np.nonzero(np.arccos(np.clip(_matrix(p.column(4)) @ centre.T, -1, 1)) <= limit)
                times = parts[shard]
                row, part = np.repeat(row, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                shard = np.repeat(shard, times)
                yield pa.record_batch([pa.array(shard, pa.int32()), pa.array(part), p.column(2).take(pa.array(row)), p.column(4).take(pa.array(row))],
                                      names=["q_shard", "q_part", "q_rep", "q_vec"])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"rep": right["q_rep"], "found": pa.array(np.zeros(len(right), np.int64)), "root": right["q_rep"]})
        return _compared(_matrix(left["vec"]), left["rep"].to_numpy(), left["copies"].to_numpy(), _matrix(right["q_vec"]),
                         right["q_rep"].to_numpy(), reach)

    number = F.element_at(F.lit(parts.tolist()), F.col("shard") + 1)
    # queries of a part come in blocks, each with its own copy of the part
    blocks = max(1, -(-n // (SHARD_MOST * 16)))
    node = homes.withColumn("part", F.pmod(F.xxhash64("rep"), number)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    query = homes.mapInArrow(ask, "q_shard int, q_part bigint, q_rep bigint, q_vec array<float>").withColumn(
        "q_block", F.pmod(F.xxhash64("q_rep", F.lit(1)), F.lit(blocks)).cast("int"))
    return node.groupBy("shard", "part", "block").cogroup(query.groupBy("q_shard", "q_part", "q_block")).applyInArrow(match, FOUND)


def near_duplicates(vectors: DataFrame, reach: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for each vector."""
    v = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vec_col].cast("array<float>").alias("vec"))
    v = v.withColumn("ok", _valid() & F.col("vec_id").isNotNull())
    points = written(v.where("ok").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", "vec"),
                     "points")
    lengths = points.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    often = lengths.orderBy(F.desc("n"), "d").limit(LENGTHS)
    large = {r["d"]: r["n"] for r in often.unionByName(lengths.where(F.col("n") > SMALL)).collect()}
    some = points if not large else points.where(~F.size("vec").isin(list(large)))
    found = written(_links_of_small(some, reach), "links")
    shares: list[float | None] = [] if large else [1.0]
    for d, n in sorted(large.items()):
        part = points.where(F.size("vec") == d)
        for overlap, beam in ((OVERLAP, BEAM), (2 * OVERLAP, 2 * BEAM), (4 * OVERLAP, 4 * BEAM)):
            got = written(_links(part, n, reach, overlap, beam), "links")
            share, whole = audit(part, got, reach)
            if share is None or share >= RECALL_LEAST:
                break
        if share is not None and share < RECALL_BOUND:
            got, share = written(_links_exact(part, n, reach), "links"), 1.0
        shares.append(1.0 if share is None and whole else share)
        found = found.unionByName(got)
    # the least measured; NULL if a length could not be measured (no sampled point has a link)
    recall = None if None in shares else min(shares)
    comp = components(found.where("rep != root").select("rep", "root"), "rep", "root")
    per = found.groupBy("rep").agg(F.sum("found").alias("found"))
    label = points.join(per, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("vec").alias("v"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    joined = v.join(label, v["ok"] & (v["vec"] == label["v"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
