"""Packing and splitting against plain loops (property tests)."""

import math
import random
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from revlens.operators import chunking as D
from revlens.operators import corpus as C
from revlens.operators import packing
from revlens.operators.prompts import render_prompts
from revlens.operators.scoring import WhitespaceEncoder, split_by_tokens


def loop_pack(files, B):
    """The plain next-fit loop: files sorted by (lower(rel), rel)."""
    W = max(1000, 3 * B)
    out = []
    for proj in sorted({p for p, _, _ in files}):
        rows = sorted([(r, t) for p, r, t in files if p == proj], key=lambda x: (x[0].lower(), x[0]))
        cid = cur = pos = 0
        for rel, text in rows:
            tok = max(1, round(len(text) / 3.5))
            if tok > B:
                n = math.ceil(len(text) / W)
                for k in range(n):
                    cid += 1
                    out.append((proj, cid, 0, f"{rel} [part {k + 1}/{n}]"))
                cur = 0
            elif cur == 0 or cur + tok > B:
                cid, cur, pos = cid + 1, tok, 0
                out.append((proj, cid, pos, rel))
            else:
                cur, pos = cur + tok, pos + 1
                out.append((proj, cid, pos, rel))
    return sorted(out)


def packed(spark, files, B, **kw):
    df = spark.createDataFrame(files, "project string, relative string, text string")
    m = D.pack_chunks(C.corpus_from_table(df), B, **kw)
    return sorted((r["project"], r["chunk_id"], r["pos"], r["relative"]) for r in m.collect())


corpus = st.lists(st.tuples(st.sampled_from(["p1", "p2", "P3"]),
                            st.integers(0, 40), st.integers(0, 16000)), min_size=1, max_size=40)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(corpus, st.sampled_from([1500, 2000, 3100]))
def test_pack_equals_loop(spark, spec, B):
    files = {}
    for p, i, n in spec:
        files[(p, f"d{i % 7}/F{i}.py")] = "x" * n
    rows = [(p, r, t) for (p, r), t in files.items()]
    expect = loop_pack(rows, B)
    assert packed(spark, rows, B) == expect
    assert packed(spark, rows, B, num_partitions=1) == packed(spark, rows, B, num_partitions=23) == expect


def test_chunks_within_budget_and_ordered(spark, sf):
    from revlens.plans.queries import reviewable
    rv = reviewable(spark, sf)
    m = D.pack_chunks(rv, 3100)
    heads = D.chunk_headers(m)
    assert heads.where((F.col("n_files") > 1) & (F.col("tokens") > 3100)).count() == 0
    assert m.where(F.col("tokens") > 3100).count() == 0      # parts of oversized files fit as well
    # every reviewable file is placed exactly once (parts count once per file)
    base = m.select("project", F.regexp_replace("relative", r" \[part \d+/\d+\]$", "").alias("r")).distinct()
    assert base.count() == rv.count()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=3000), st.integers(1, 700))
def test_hard_split_concatenates(spark, text, width):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    parts = D.hard_split(df, F.lit(width)).orderBy("part_no").collect()
    assert "".join(p["part_text"] for p in parts) == text
    assert len(parts) == (math.ceil(len(text) / width) if text else 0)
    assert all(p["part_count"] == len(parts) for p in parts)


def test_split_by_tokens(spark):
    df = spark.createDataFrame([(1, "a bb  ccc d e f g"), (2, "")], "id int, text string")
    rows = split_by_tokens(df, WhitespaceEncoder(), 3).orderBy("id", "part_no").collect()
    assert [r["part_text"] for r in rows] == ["a bb  ccc", " d e f", " g"]
    assert [r["part_tokens"] for r in rows] == [3, 3, 1]


def test_retry_split_rules(spark):
    rows = [("p", 1, 0, "a.py", "x" * 4000), ("p", 1, 1, "b.py", "x" * 3000),    # several files
            ("p", 2, 0, "c.py", "x" * 3000),                                      # total <= 1500: none
            ("p", 3, 0, "big.py", "y" * 12000)]                                   # one file: hard split
    df = spark.createDataFrame(rows, "project string, chunk_id bigint, pos int, relative string, text string")
    df = df.withColumn("tokens", F.greatest(F.lit(1), F.round(F.length("text") / 3.5).cast("bigint"))) \
        .withColumn("size", F.length("text").cast("bigint")).withColumn("lines", F.lit(1).cast("bigint"))
    df = df.withColumn("part_no", F.lit(None).cast("int"))
    out = D.retry_split(df.drop("text"), df.select("project", "relative", "part_no", "tokens", "text")).orderBy("chunk_id", "sub_id", "pos").collect()
    got = [(r["chunk_id"], r["sub_id"], r["relative"]) for r in out]
    assert got[:2] == [(1, 1, "a.py"), (1, 2, "b.py")]
    assert all(c != 2 for c, _, _ in got)
    big = [g for g in got if g[0] == 3]
    assert [g[2] for g in big] == ["big.py [retry-part 1/3]", "big.py [retry-part 2/3]", "big.py [retry-part 3/3]"]


def _prompts(files, budget, n=None, only=None):
    members = D.pack_chunks(files, budget)
    if only is not None:
        members = members.where(only)
    return {(r["project"], r["chunk_id"]): r for r in render_prompts(members, files, budget, n).collect()}


def test_prompt_layout(spark):
    files = C.corpus_from_table(spark.createDataFrame([("proj", "a.py", "print(1)\nx"), ("proj", "b.py", "y")], "project string, relative string, text string"))
    p = _prompts(files, 3100)["proj", 1]["prompt"]
    assert p == ("Project: proj\nReview chunk: 1/1\n\nPaths are relative to the project root.\n"
                 "Review the following source files:\n\n===== FILE: a.py | LOC: 2 =====\nprint(1)\nx\n"
                 "===== END FILE =====\n\n===== FILE: b.py | LOC: 1 =====\ny\n===== END FILE =====")


@pytest.mark.parametrize("n", [1, 4, 37])
def test_prompts_in_any_slices(spark, n):
    """Chunks that cross slices, parts, repeated files and labels like parts."""
    rng = random.Random(n)
    rows = [(rng.choice(["p", "q", None]), f"d/F{i:03d}{rng.choice(['.py', '.PY'])}", f"{i} é\n" * rng.choice([1, 5, 90, 400, 3000])) for i in range(90)]
    rows += [("p", "d/F001.py [part 1/2]", "like a part"), ("p", "d/twice.py", "one"), ("p", "d/twice.py", "the other\n\n")]
    files = C.corpus_from_table(spark.createDataFrame(rows, "project string, relative string, text string"))
    members = D.pack_chunks(files, 1500)
    texts = {}
    for r in D.member_texts(files, 1500).collect():
        texts.setdefault((r["project"], r["relative"], r["part_no"], r["lines"], r["tokens"]), []).append(r["text"])
    chunks = {}
    for r in members.collect():
        chunks.setdefault((r["project"], r["chunk_id"]), []).append(r)
    heads = {(r["project"], r["chunk_id"]): (r["n_files"], r["tokens"], r["signature"]) for r in D.chunk_headers(members).collect()}
    got = _prompts(files, 1500, n)
    assert set(got) == set(chunks)
    for key, rows in chunks.items():
        assert (got[key]["n_files"], got[key]["tokens"], got[key]["signature"]) == heads[key]
        body = "\n".join(f"\n===== FILE: {m['relative']} | LOC: {m['lines']} =====\n{texts[m['project'], m['relative'], m['part_no'], m['lines'], m['tokens']][0]}"
                         "\n===== END FILE =====" for m in sorted(rows, key=lambda m: m["pos"]))
        if key[0] is not None:
            last = max(c for p, c in chunks if p == key[0])
            assert got[key]["prompt"] == (f"Project: {key[0]}\nReview chunk: {key[1]}/{last}\n\nPaths are relative to the project root.\n"
                                          f"Review the following source files:\n{body}")
    some = _prompts(files, 1500, n, "chunk_id % 3 = 1")
    assert set(some) == {k for k in chunks if k[1] % 3 == 1} and all(some[k]["signature"] == heads[k][2] for k in some)


def test_texts_move_once(spark, sf):
    """The prompts' plan has one exchange with whole texts (the range of the
    slices) and one of pieces; retry splits have none."""
    from revlens.plans import queries as Q

    def texts_exchanged(df):
        said = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (\w+)", said)
        assert found
        return [kind for columns, kind in found if re.search(r"\b(text|body|part_text)#", columns)]

    assert texts_exchanged(Q.d5_retry_split(spark, sf)) == []
    # the one exchange is read twice (reused when it runs); the second time only pieces go on
    assert texts_exchanged(Q.d6_prompts(spark, sf)) == ["rangepartitioning"] * 2


def test_one_project_in_any_slices(spark, sf):
    """One project that holds all documents, in few and many slices."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [("all", f"d/{r['doc_id']}.py", r["text"]) for r in docs.select("doc_id", "text").collect()]
    for budget in (1500, 20_000):
        want = loop_pack(rows, budget)
        assert packed(spark, rows, budget, num_partitions=3) == packed(spark, rows, budget, num_partitions=60) == want


def _loop_state(tokens, parts, budget, state):
    begun, fill, members = state
    at = []
    for t, p in zip(tokens, parts):
        if t > budget:
            at.append((begun + 1, 0))
            begun, fill, members = begun + p, 0, 0
        elif fill == 0 or fill + t > budget:
            begun, fill, members = begun + 1, t, 1
            at.append((begun, 0))
        else:
            fill, members = fill + t, members + 1
            at.append((begun, members - 1))
    return (begun, fill, members), at


def test_slice_tables_are_the_fold():
    rng = random.Random(3)
    for _ in range(400):
        budget = rng.choice([5, 12, 40])
        tokens = np.array([rng.choice([1, 2, 3, budget, budget + 1, rng.randint(1, budget + 3)]) for _ in range(rng.randint(0, 25))], dtype=np.int64)
        parts = np.array([rng.randint(1, 3) for _ in tokens], dtype=np.int64)
        s = packing.Slice(tokens, parts, budget)
        table = s.table()
        assert [r[0] for r in table] == sorted({r[0] for r in table}, reverse=True) and table[-1][0] == 1
        for fill in range(budget + 1):
            entry = (7, fill, 2 if fill else 0)
            want, at = _loop_state(tokens.tolist(), parts.tolist(), budget, entry)
            assert packing.apply_table(table, entry) == s.leave(entry) == want, (tokens, budget, entry)
            chunk, place = s.place(entry)
            assert list(zip(chunk.tolist(), place.tolist())) == at


def test_budgets_in_one_pass(spark, sf):
    from revlens.plans.queries import reviewable

    rv = reviewable(spark, sf)
    budgets = [1500, 3100, 4096, 65_536]
    got = {(r["project"], r["budget"]): r["chunks"] for r in packing.chunk_counts(rv, [(b, 3 * b) for b in budgets], 5).collect()}
    for b in budgets:
        want = {(r["project"], b): r["n"] for r in D.pack_chunks(rv, b).groupBy("project").agg(F.countDistinct("chunk_id").alias("n")).collect()}
        assert {k: v for k, v in got.items() if k[1] == b} == want


def test_packing_is_planned_without_a_job(spark, sf):
    from revlens.plans.queries import reviewable

    rv = reviewable(spark, sf)
    spark.sparkContext.setJobGroup("pack", "plans only")
    try:
        plan = D.pack_chunks(rv, 3100)._jdf.queryExecution().executedPlan().toString()
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("pack")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "ReusedExchange" in plan or "AdaptiveSparkPlan" in plan


def test_null_project_and_label_like_names(spark):
    rows = [(None, "a.py", "x" * 100), ("p", "x [part 1/2]", "whole"), ("p", "big.py", "😀\n" * 4000), (None, "b.py", "y" * 9000)]
    files = C.corpus_from_table(spark.createDataFrame(rows, "project string, relative string, text string"))
    for n in (None, 2):
        members = D.pack_chunks(files, 1500, n)
        got = D.member_texts(files, 1500).collect()
        assert len(got) == members.count()
        whole = {(r["project"], r["relative"]): r["text"] for r in got if r["part_no"] is None}
        assert whole == {(None, "a.py"): "x" * 100, ("p", "x [part 1/2]"): "whole"}
        for p, name, text in rows:
            parts = sorted((r["part_no"], r["text"]) for r in got if r["part_no"] and r["relative"].startswith(name + " [") and r["project"] == p)
            assert not parts or "".join(t for _, t in parts) == text
        assert members.select("project", "chunk_id").distinct().count() == len(_prompts(files, 1500, n))


def test_signature_has_one_meaning_at_every_size(spark):
    import hashlib

    def tree(payloads, fanout):
        for k in range(4):
            step = fanout if k < 3 else len(payloads)
            payloads = [hashlib.sha256("|".join(payloads[i:i + step]).encode()).hexdigest() for i in range(0, len(payloads), step)]
        return payloads[0]

    for n in (1, 3, 4, 5, 17, 60):
        df = spark.createDataFrame([("k", i + 1, f"v{i}") for i in range(n)], "k string, o long, p string")
        got = C.ordered_digest(df, ["k"], "o", {"d": "p"}, fanout=4).first()["d"]
        assert got == tree([f"v{i}" for i in range(n)], 4), n
