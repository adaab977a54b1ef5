"""The replayed attempt log against a loop over each chunk."""

import random

from pyspark.sql import functions as F

from revlens.operators import attempts as A
from revlens.operators import history as J

SCHEMA = "project string, chunk_id long, ts timestamp_ntz, event_id long, status int, detail string"


def _log(rng, n, chunks):
    import datetime as dt
    kinds = [(200, ""), (429, "slow down"), (503, ""), (400, "maximum context exceeded"), (400, "bad"), (401, "key"), (None, "connection reset"),
             (None, "no idea")]
    return [(rng.choice(["p", None]), rng.choice(chunks), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(n // 3)), i,
             *rng.choice(kinds[:4] * 3 + kinds)) for i in range(n)]


def _loop(log):
    out = {}
    for key in {(r[0], r[1]) for r in log}:
        call = attempt = 0
        done, fresh = False, True
        for r in sorted((r for r in log if (r[0], r[1]) == key), key=lambda r: (r[2], r[3])):
            status, detail = r[4], r[5]
            if fresh:
                call, attempt = call + 1, 0
            attempt += 1
            if status is not None and 200 <= status < 300:
                action = "done"
            elif status == 400 and "context" in detail:
                action = "split"
            elif (status in (429, 503) or (status is None and "connection reset" in detail)) and attempt < 5:
                action = "retry"
            else:
                action = "fail"
            out[r[3]] = (call, attempt, action, done)
            fresh, done = action != "retry", done or action == "done"
    return out


def test_replay_equals_the_loop(spark):
    rng = random.Random(1)
    log = _log(rng, 900, [1, 1, 1, 1, 2, 3, 4])        # one chunk has over half
    got = A.replay_attempts(spark.createDataFrame(log, SCHEMA).repartition(5))
    rows = {r["event_id"]: (r["call_no"], r["attempt_no"], r["action"], r["spare"]) for r in got.collect()}
    assert rows == _loop(log) and got.columns[:6] == [c.split()[0] for c in SCHEMA.split(", ")]
    assert A.replay_attempts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ledger_and_bill(spark):
    import datetime as dt
    t = lambda i: dt.datetime(2024, 1, 1, 0, i)
    log = [("p", 1, t(0), 1, 503, ""), ("p", 1, t(1), 2, 200, ""), ("p", 1, t(2), 3, 200, ""),
           ("p", 2, t(0), 4, 401, "no key"), ("p", 3, t(0), 5, None, "connection reset"), ("p", 4, t(0), 6, 400, "bad"), ("p", 4, t(1), 7, 400, "context"),
           ("p", 5, t(0), 8, 401, "first"), ("p", 5, t(1), 9, 500, "then down"), ("p", 9, t(0), 10, 200, "")]
    heads = spark.createDataFrame([("p", i, f"s{i}", 10 * i) for i in range(1, 6)] + [("q", 1, "t", 7)],
                                  "project string, chunk_id long, signature string, tokens long")
    members = spark.createDataFrame([("p", i, j, f"f{i}{j}") for i in range(1, 6) for j in (1, 0)],
                                    "project string, chunk_id long, pos int, relative string")
    replayed = A.replay_attempts(spark.createDataFrame(log, SCHEMA))
    led = sorted(tuple(r) for r in A.failed_chunks(replayed, heads, members).collect())
    # chunk 3 is still being tried, chunk 4 was split; chunk 5's last failure is its first attempt
    assert led == [("p", 2, "s2", ["f20", "f21"], 20, 1, "HTTP 401: no key"), ("p", 5, "s5", ["f50", "f51"], 50, 2, "HTTP 401: first")]
    bill = {r["project"]: r.asDict() for r in J.billed_tokens(heads, replayed).collect()}
    assert bill["p"] == {"project": "p", "chunks": 5, "code_tokens": 150, "planned": 150 + 7500, "requests": 9, "retries": 3, "splits": 1, "failures": 3,
                         "done": 1, "billed": 2 * 1510 + 1530, "wasted": 1510 + 1530}
    assert bill["q"]["planned"] == 1507 and bill["q"]["billed"] == 0


def test_one_chunk_spreads_over_slices(spark):
    log = spark.range(4000).select(F.lit("p").alias("project"), F.lit(1).cast("long").alias("chunk_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("ts"),
                                   F.col("id").alias("event_id"), F.when(F.col("id") % 7 == 6, 200).otherwise(503).alias("status"), F.lit("").alias("detail"))
    got = A.replay_attempts(log)
    assert got.where("attempt_no > 5").count() == 0
    assert got.agg(F.max("call_no")).first()[0] == 2 * (4000 // 7) + 1
