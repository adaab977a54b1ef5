"""Streams: batch equality on closed windows, late data, restart."""

import datetime as dt

from pyspark.sql import functions as F

from revlens.operators import review as E
from revlens.sources import fixtures as V
from revlens.streaming import streams as S


def test_rates_equal_batch_on_closed_windows(spark, sf):
    got = S.s1_rate_per_minute(spark, sf)
    a = V.attempts_v(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    mx = a.agg(F.max("ts")).first()[0]
    b = (a.groupBy(F.window("ts", "1 minute"), "provider").agg(F.count(F.lit(1)).alias("requests"))
         .where(F.col("window.end") <= F.lit(mx - dt.timedelta(minutes=10))))
    assert got.count() == b.count()
    assert got.agg(F.sum("requests")).first()[0] == b.agg(F.sum("requests")).first()[0]


def test_dedup_and_late_rows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    schema = "ts timestamp_ntz, k string, v int"
    src = tmp_path / "in"
    spark.createDataFrame([(t0, "a", 1), (t0 + dt.timedelta(minutes=1), "a", 2),     # duplicate inside
                           (t0 + dt.timedelta(minutes=30), "b", 3)], schema).coalesce(1) \
        .write.parquet(str(src / "f1"))
    spark.createDataFrame([(t0 + dt.timedelta(minutes=31), "b", 5)], schema).coalesce(1).write.parquet(str(src / "f2"))
    # later than the watermark of the batch before
    spark.createDataFrame([(t0 + dt.timedelta(minutes=2), "c", 4), (t0 + dt.timedelta(minutes=32), "d", 6)], schema).coalesce(1) \
        .write.parquet(str(src / "f3"))
    import os
    for i in (1, 2, 3):
        for f in os.listdir(src / f"f{i}"):
            os.utime(src / f"f{i}" / f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.stream_dir(spark, str(src / "*"), spark.createDataFrame([], schema).schema, max_files=1)
    out = S.run_available(S.dedup_stream(stream, ["k"]).select("k", "v"), "t-dedup")
    got = sorted((r["k"], r["v"]) for r in out.collect())
    assert got == [("a", 1), ("b", 3), ("d", 6)]      # a/2 and b/5 repeat keys; c/4 arrives after the watermark


def test_the_earliest_attempt_stays(spark, sf):
    """Whole rows, the same ones in every run: the first event of each key."""
    a = V.attempts_v(spark, sf)
    keys = ["provider", "chunk_id", "attempt"]
    want = a.groupBy(*keys).agg(F.min(F.struct("ts", "event_id", "status")).alias("m")).select("m.event_id", *keys, "m.status")
    got = S.s4_dedup_stream(spark, sf)
    assert got.columns == want.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((tuple(r) for r in want.collect()), key=str)
    assert want.count() < a.count() and want.where("status is null").count()


def test_rows_of_many_batches_go_by_the_watermark(spark, tmp_path):
    """A late row hides no timely one of its key, a key is forgotten in time
    though it was seen again, a row without a time stays, values stay as they are."""
    import os

    t0, big = dt.datetime(2024, 1, 1, 12), 2**60 + 1
    schema = "ts timestamp_ntz, k string, v int, n long, x double"
    at = lambda m: t0 + dt.timedelta(minutes=m)
    batches = [[(at(0), "a", 1, big, None), (at(0), "m", 0, None, 0.5), (at(30), "b", 2, None, float("nan")), (at(30), None, 3, 1, 1.0)],
               # the watermark is at 20
               [(at(2), "c", 4, big, 1.0), (at(25), "c", 5, big, 1.0), (at(21), "a", 6, 1, 1.0), (at(50), "e", 7, 1, 1.0)],
               # at 40: a is forgotten, b is known at the beginning; d is not later than the watermark
               [(at(45), "a", 8, 1, 1.0), (at(41), "b", 9, 1, 1.0), (at(40), "d", 10, None, None), (None, "n", 11, 1, 1.0), (None, "e", 12, 1, 1.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        for f in os.listdir(tmp_path / f"in/f{i}"):
            os.utime(tmp_path / f"in/f{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.stream_dir(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, max_files=1)
    out = S.run_available(S.dedup_stream(stream, ["k"], order=["v"]).select("v", "k", "n", F.col("x").cast("string")), "t-batches")
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, "m", None, "0.5"), (1, "a", big, None), (2, "b", None, "NaN"), (3, None, 1, "1.0"), (5, "c", big, "1.0"),
        (7, "e", 1, "1.0"), (8, "a", 1, "1.0"), (10, "d", None, None), (11, "n", 1, "1.0")]


def test_a_key_is_remembered_for_the_delay(spark, tmp_path):
    import os

    import pytest

    t0, schema = dt.datetime(2024, 1, 1, 12), "ts timestamp_ntz, k string, v int"
    for i, rows in enumerate([[(0, "a", 1), (30, "z", 2)], [(60, "y", 3)], [(52, "a", 4), (53, "y", 5)]]):
        rows = [(t0 + dt.timedelta(minutes=m), k, v) for m, k, v in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
        for f in os.listdir(tmp_path / f"in/f{i}"):
            os.utime(tmp_path / f"in/f{i}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.stream_dir(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema, max_files=1)
    for delay, want in ((10, [1, 2, 3, 4]), (60, [1, 2, 3])):
        out = S.run_available(S.dedup_stream(stream, ["k"], delay_minutes=delay).select("v"), "t-delay")
        assert sorted(r["v"] for r in out.collect()) == want
    with pytest.raises(ValueError):
        S.dedup_stream(stream, ["k"], delay_minutes=5)


def test_no_call_for_each_key(spark, sf):
    """Keys go to Python in groups, as blocks of rows; those seen are Spark's own state."""
    a = V.attempts_from_events(S.stream_table(spark, sf, "events"))
    plan = S.dedup_stream(a, ["provider", "chunk_id", "attempt"])._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan and "FlatMapGroups" not in plan
    (grouped,) = [x for x in plan.splitlines() if "TransformWithState" in x]
    assert "transformWithStateUDF(_group#" in grouped and "block#" in grouped


def test_blocks_hold_every_row_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(S, "PACK_BYTES", 60_000)
    n = 5_000
    ts = pa.array([None if i % 11 == 0 else 1_700_000_000_000_000 + i for i in range(n)], pa.timestamp("us", "UTC"))
    t = pa.table({"ts": ts, "v": range(n), "_group": pa.array([i * i % 7 for i in range(n)], pa.int32())})
    out = pa.Table.from_batches(S._blocks(iter([t.to_batches()[0].slice(0, 0), *t.to_batches(max_chunksize=500)])))
    got = []
    for g, latest, block in zip(*(out.column(c).to_pylist() for c in ("_group", "ts", "block"))):
        rows = pa.ipc.open_stream(block).read_all().to_pylist()
        assert all(r["v"] ** 2 % 7 == g for r in rows) and len(block) < 6_000
        assert latest == (None if rows[0]["ts"] is None else max(r["ts"] for r in rows))
        got += rows
    assert sorted(got, key=lambda r: r["v"]) == t.drop_columns("_group").to_pylist() and 40 < out.num_rows < 200


def _batch_arrivals(docs):
    """What S5 finds, without a stream: the replies' findings, then the rules'."""
    p = E.parse_replies(S.chunks_from_documents(docs))
    told = F.coalesce(F.try_variant_get("v", "$.findings", "array<variant>"), F.array().cast("array<variant>"))
    found = F.posexplode(F.concat(told, E.rule_objects(F.col("text"), F.col("file"))))
    return p, E.typed_findings(p.where("ok").select("project", "chunk_id", found.alias("pos", "f")))


def _parts(docs, src, n):
    """The documents as n files in order of their ids and of time."""
    import os

    rows = docs.orderBy("doc_id").collect()
    step = -(-len(rows) // n)
    for i in range(n):
        path = f"{src}/p{i:02d}"
        docs.sparkSession.createDataFrame(rows[i * step:(i + 1) * step], docs.schema).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
        yield


def test_stream_equals_batch_over_many_batches_and_restarts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src, out, ck = tmp_path / "docs", str(tmp_path / "tables"), str(tmp_path / "ck")

    def run():
        s = S.stream_dir(spark, f"{src}/*", docs.schema, max_files=1)
        return S.incremental_review(S.chunks_from_documents(s), out, ck)

    made = _parts(docs, str(src), 5)
    for _ in range(2):
        next(made)
    run()
    early = spark.read.parquet(f"{out}/unique").count()
    for _ in made:
        pass
    assert sum(len([p for p in q.recentProgress if p["numInputRows"]]) for q in run()) >= 4     # goes on: one batch a file and per batch of arrivals
    parsed, found = _batch_arrivals(docs)
    cols = ["project", "dedup_key", "chunk_id", "pos", "severity", "file", "line_raw", "title", "evidence"]
    want = sorted((tuple(r) for r in E.dedup_findings(found).select(*cols).collect()), key=str)
    got = sorted((tuple(r) for r in spark.read.parquet(f"{out}/unique").select(*cols).collect()), key=str)
    assert got == want and early < len(want)
    arrivals = spark.read.parquet(f"{out}/arrivals")
    assert arrivals.where("pos is null").count() == docs.count() and arrivals.where("pos is not null").count() == found.count()
    assert S.open_failures(arrivals).count() == parsed.where("not ok").count()
    # the same chunks once more: completed ones are not reviewed again, failed ones are
    docs.coalesce(1).write.parquet(f"{src}/again")
    run()
    again = spark.read.parquet(f"{out}/arrivals")
    assert again.where("pos is not null").count() == found.count()
    assert again.where("pos is null").count() == docs.count() + parsed.where("not ok").count()
    assert sorted((tuple(r) for r in spark.read.parquet(f"{out}/unique").select(*cols).collect()), key=str) == want


def test_a_later_reply_completes_a_failed_chunk(spark, tmp_path):
    schema = "project string, chunk_id long, signature string, file string, text string, raw string"
    good = '{"findings": [{"title": "t", "file": "a"}, 7, {"title": "t", "file": "a"}]}'
    batches = [[("p", 1, "s1", "a.py", "x", "oops"), ("p", 2, "s2", "b.py", "eval(x)", "")],
               [("p", 1, "s1", "a.py", "x", "oops again"), ("p", 3, "s1", "a.py", "x", good)],
               [("p", 4, "s1", "a.py", "x", "late"), ("p", 5, "s3", "c.py", "", '{"summary": "none"}'), ("q", 5, "s1", "a.py", "x", good)]]
    out, ck = str(tmp_path / "t"), str(tmp_path / "ck")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        S.incremental_review(S.stream_dir(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema), out, ck)
    arrivals = spark.read.parquet(f"{out}/arrivals")
    replies = sorted((r["project"], r["chunk_id"], r["ok"]) for r in arrivals.where("pos is null").collect())
    assert replies == [("p", 1, False), ("p", 1, False), ("p", 2, False), ("p", 3, True), ("p", 5, True), ("q", 5, True)]
    assert [(r["project"], r["chunk_id"]) for r in S.open_failures(arrivals).collect()] == [("p", 2)]
    assert sorted((r["project"], r["chunk_id"], r["pos"]) for r in spark.read.parquet(f"{out}/unique").collect()) == [("p", 3, 0), ("q", 5, 0)]


def test_first_arrivals_of_a_batch(spark, monkeypatch):
    """One row a key before the state is asked, whatever the order of rows."""
    import random

    monkeypatch.setattr(S, "FOLD_ROWS", 3)
    big = 2**53 + 1
    rows = [(p, k, c, i, big + c) for p in ("a", None) for k in ("x", "y") for c in (3, 1, 2) for i in (1, 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "project string, dedup_key string, chunk_id long, pos int, line long").repartition(3)
    got = S.first_arrivals(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((p, k, 1, 0, big + 1) for p in ("a", None) for k in ("x", "y")), key=str)
