"""SimHash, embeddings, decontamination, substring dedup and LM scores against
brute force."""

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import decontaminate, embedding_dedup, lm_score, simhash, substring_dedup
from revlens.llm.components import components


def _roots(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def _slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, k) for k in range(300, 340)]
    want = _roots(340, pairs)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}


def test_tree_search_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    pts = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) for _ in range(4)]))
    got = {(a, b) for x, y in simhash.links_within(pts, pts, 2) for a, b in zip(x.tolist(), y.tolist())}
    x, y = np.nonzero(np.bitwise_count(pts[:, None] ^ pts[None]) <= 2)
    assert got == {(a, b) for a, b in zip(x.tolist(), y.tolist()) if a != b}


def _check_simhash(rows, got):
    fps = [_slow_fingerprint(t) for _, t in rows]
    root = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    low = {}
    for (i, _), r in zip(rows, root):
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    want = sorted(((i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_simhash_odd_rows(docs, none):
    _check_simhash([(r["doc_id"], r["text"]) for r in docs.collect()], simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(none).collect() == []


def test_simhash_tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    _check_simhash([(r["doc_id"], r["text"]) for r in d.collect()], simhash.near_duplicates(d).collect())


def test_keep_one(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # doc_id 8 is the id of two different texts: two classes of one id
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [_slow_fingerprint(t) for _, t in rows]
    root = _roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    low = [min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)]
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert got == sorted(low, key=str) and got.count(8) == 2
    assert simhash.keep_one(none).collect() == []


def test_decontaminate_odd_rows(spark, docs, none):
    items = [("a", "the quick brown fox jumps over a lazy dog and runs far away"), ("b", "Short."), ("c", None), ("d", " .. "),
             ("e", "naïve 日本語"), ("b2", "short"), ("f", "nothing of this is anywhere at all in these few texts really")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(decontaminate.brute_force(rows, items), key=str)
    for size in (1 << 20, 300):     # one block, several passes
        found = decontaminate.find_spans(docs, bench, block_bytes=size)
        assert sorted((tuple(r) for r in decontaminate.digest(found).collect()), key=str) == want
    assert decontaminate.find_spans(none, bench).collect() == []
    clean = decontaminate.digest(decontaminate.find_spans(docs, bench.where("false"))).collect()
    assert not any(r["contaminated"] for r in clean)
    left = decontaminate.cut(docs, bench)
    assert left.columns == docs.columns
    assert not any(r["contaminated"] for r in decontaminate.digest(decontaminate.find_spans(left, bench.where("item_id = 'a'"))).collect()
                   if r["doc_id"] not in (2, 7))
    assert {r["doc_id"] for r in left.collect()} >= {1, 2, 3, 4, 5, 9}


def test_cut_is_the_same_in_any_blocks(spark):
    w = [f"w{i}" for i in range(1, 16)]
    items = [("a", " ".join(w[:10])), ("b", " ".join(w[5:])), ("c", " ".join(f"v{i}" for i in range(10))), ("d", "q1 " + "x" * 40)]
    items += [(f"e{i}", f"lone{i} filler{i} " + "z" * 30 + str(i)) for i in range(12)]
    rows = [(1, " ".join(w)), (2, "before " + " ".join(w) + " after, and more"), (3, None), (4, "clean"), (5, "..."),
            # without the passage of item a the rest would read as item c
            (6, "v0 v1 v2 v3 v4 " + " ".join(w[:10]) + " v5 v6 v7 v8 v9"),
            (7, " ".join(w[:10]) + " - " + " ".join(f"v{i}" for i in range(10)) + "; end")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _spans string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    blocks = list(decontaminate.blocks(bench, "item_id", "text", 300))
    assert sum(any(i in "abc" for i, _ in b) for b in blocks) >= 2      # the overlapping items are in several blocks
    want = {1: None, 2: "before  after, and more", 3: None, 4: "clean", 5: "...", 6: "v0 v1 v2 v3 v4  v5 v6 v7 v8 v9", 7: "; end"}
    del want[1]
    for size in (decontaminate.BLOCK_BYTES, 300, 60):
        got = decontaminate.cut(d, bench, block_bytes=size)
        assert got.schema == d.schema
        assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_items_without_id_count(spark):
    w = [f"w{i}" for i in range(12)]
    bench = spark.createDataFrame([(None, " ".join(w[:10])), (None, "solo"), ("a", "other words")], "item_id string, text string")
    d = spark.createDataFrame([(1, "x " + " ".join(w) + " solo"), (2, "solo other words z"), (3, "clean")], "doc_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 60):
        got = {r["doc_id"]: r for r in decontaminate.find_spans(d, bench, block_bytes=size).collect()}
        assert [got[i]["items"] for i in (1, 2, 3)] == [[None], ["a", None], []]
        n = {r["doc_id"]: tuple(r) for r in decontaminate.digest(decontaminate.find_spans(d, bench, block_bytes=size)).collect()}
        assert list(n.values()) and n == {r[0]: r for r in decontaminate.brute_force(
            [(r["doc_id"], r["text"]) for r in d.collect()], [tuple(r) for r in bench.collect()])}
        assert [n[i][2:4] for i in (1, 2, 3)] == [(11, 1), (3, 2), (0, 0)]
        assert {r["doc_id"]: r["text"] for r in decontaminate.cut(d, bench, block_bytes=size).collect()} == {
            1: "x  w10 w11 ", 2: " z", 3: "clean"}


def test_fm_index_locates_every_occurrence():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(50)] + [np.ones(100, np.int64)]
    seq = np.concatenate([np.append(r, 0) for r in runs])
    index = decontaminate.FMIndex(seq, 4)
    for size in (1, 2, 5, 9):
        pats = np.unique(rng.integers(1, 4, (30, size)), axis=0)
        pad = np.concatenate([np.zeros((len(pats), 10 - size), np.int64), pats], axis=1)
        lo, hi = index.search(pad, np.full(len(pats), size))
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(len(seq) - size + 1) if (seq[i:i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_substring_dedup(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    d = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert sorted(tuple(r) for r in substring_dedup.digest(substring_dedup.dedup_substrings(d)).collect()) == substring_dedup.brute_force(rows)
    every = substring_dedup.digest(substring_dedup.dedup_substrings(docs)).collect()
    assert len(every) == docs.count()
    assert sorted(r["n_removed"] for r in every if r["doc_id"] == 6) == [0, 0]
    assert substring_dedup.dedup_substrings(none).collect() == []


def test_substring_dedup_short_windows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.digest(substring_dedup.dedup_substrings(d, window=5)).collect())
    assert got == substring_dedup.brute_force(rows, 5)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(docs, none, order):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 6))
    got = sorted((tuple(r) for r in lm_score.score(docs, order).collect()), key=key)
    want = sorted(lm_score.brute_force(rows, order), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], abs_tol=1e-9) and (a[4] is None) == (b[4] is None) for a, b in zip(got, want))
    assert lm_score.score(none, order).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(scale=0.03, size=(40, 16)) for c in centre] + [rng.normal(size=(300, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(2000 + i, x[0].tolist(), 1) for i in range(30)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] + [1.0] * 15, 0), (3004, [1.0, 0.0], 0),
             (3005, [None] + [1.0] * 15, 0), (3006, [float("inf")] + [1.0] * 15, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i < 3000]
    m = np.stack([v for _, v in ok])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    root = _roots(len(ok), [(a, b) for a, b in zip(*np.nonzero(near))])
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    true = found = 0
    for k, (i, _) in enumerate(ok):
        assert got[i]["n_links"] <= near[k].sum()
        true, found = true + near[k].sum(), found + got[i]["n_links"]
        assert got[i]["component_id"] >= ok[root[k]][0]
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert found >= 0.95 * true
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(3000, 3007))
    assert embedding_dedup.near_duplicates(d.where("false")).collect() == []


def _vectors(rng, pairs, alone, group):
    """Isolated pairs at cosine 0.955, single vectors and one group of near copies."""
    def unit(n):
        x = rng.normal(size=(n, 24))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    a, b = unit(pairs), unit(pairs)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = unit(1) + rng.normal(scale=0.01, size=(group, 24))
    return np.concatenate([a, 0.955 * a + np.sqrt(1 - 0.955 ** 2) * b, unit(alone), c]).astype(np.float32)


def _true_links(x):
    m = x.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_recall_counts_isolated_pairs(spark, monkeypatch):
    """Missed pairs show in the audit beside a large group, and lead to the exact way."""
    x = _vectors(np.random.default_rng(4), 300, 800, 300)
    near = _true_links(x)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    points = d.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("vec")).cache()
    group = len(x) - 300        # a search that finds the links of the group alone
    found = spark.createDataFrame([(i, int(near[i].sum()) if i >= group else 0) for i in range(len(x))], "rep long, found long")
    share, whole = embedding_dedup.audit(points, found, 0.95)
    assert not whole and 0.2 < share < 0.5      # weighed by links it would be over 0.99
    monkeypatch.setattr(embedding_dedup, "AUDIT_FIRST", 4096)
    linked = near.any(axis=1)
    assert embedding_dedup.audit(points, found, 0.95) == (pytest.approx(linked[group:].sum() / linked.sum()), True)
    assert embedding_dedup.audit(points.where("rep < 300"), found, 0.95)[0] is None      # no link: not measured

    monkeypatch.setattr(embedding_dedup, "RECALL_LEAST", 1.5)
    monkeypatch.setattr(embedding_dedup, "RECALL_BOUND", 1.5)
    root = _roots(len(x), list(zip(*np.nonzero(near))))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(d).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(len(x))] == [(int(near[i].sum()), root[i]) for i in range(len(x))]


def test_graph_search_finds_isolated_pairs(spark):
    x = _vectors(np.random.default_rng(5), 400, 1500, 300)
    near = _true_links(x)
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    rows = {r["vec_id"]: r for r in got.collect()}
    linked = [i for i in range(800) if near[i].any()]
    assert np.mean([rows[i]["n_links"] / near[i].sum() for i in linked]) >= 0.9
    assert 0.9 <= rows[0]["audited_recall"] <= 1


def test_many_vector_lengths(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 2)
    rng = np.random.default_rng(6)
    rows = []
    for n in range(1, 90):
        v = rng.normal(size=n).astype(np.float32).tolist()
        rows += [(len(rows) + k, v if k < 2 else (-np.array(v)).tolist()) for k in range(3)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {i: ((1, i - i % 3) if i % 3 < 2 else (0, i)) for i in range(len(rows))}
