"""Plan shapes that the scale design relies on."""

import re

from pyspark.sql import functions as F

from revlens.operators import catalog as G
from revlens.operators import corpus as C
from revlens.operators import review as E
from revlens.plans import queries as Q
from revlens.plans.prefix import running_sums

PY = r"ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas|BatchEvalPython"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_do_not_read_document_text(spark, sf):
    p = plan(Q.e5_findings(spark, sf))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all("text" not in s for s in schemas), schemas


def test_statistics_stay_in_the_jvm(spark, sf):
    for q in (Q.c1_project_totals, Q.c3_language_breakdown, Q.f6_next_wait, Q.g1_normalize_catalog):
        assert not re.search(PY, plan(q(spark, sf))), q.__name__


def test_dedup_combines_map_side(spark, sf):
    p = plan(Q.e10_dedup(spark, sf))
    assert "partial_min" in p


def test_ranks_are_planned_without_a_job(spark):
    files = C.corpus_from_table(spark.createDataFrame([("p", "a.py", "x")], "project string, relative string, text string"))
    replies = spark.createDataFrame([("p", 1, "{}")], "project string, chunk_id long, raw string")
    models = spark.createDataFrame([("x", 1, 0, "m", 8)], "provider string, payload_id long, pos int, id string, context long")
    spark.sparkContext.setJobGroup("build", "plans only")
    try:
        plans = [plan(df) for df in (C.with_file_order(files), G.rank_models(models), E.rank_findings(
            E.dedup_findings(E.explode_findings(E.parse_replies(replies)))))]
        jobs = list(spark.sparkContext.statusTracker().getJobIdsForGroup("build"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == []
    assert all("rangepartitioning" in p for p in plans)


def test_rank_carries_no_evidence(spark, sf):
    p = plan(Q.e11_rank(spark, sf))
    assert not re.search(r"\b(evidence|why|fix)#", p)


def test_range_path_broadcasts_only_offsets(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("o"))
    out = running_sums(df, "k", ["o"], {"c": F.lit(1)}, num_partitions=4)
    p = plan(out)
    assert "MapInArrow" in p and "BroadcastExchange" in p
    got = {(r["k"], r["o"]): r["c"] for r in out.collect()}
    for k in "012":
        ids = sorted(o for (kk, o) in got if kk == k)
        assert [got[(k, o)] for o in ids] == list(range(1, len(ids) + 1))


def test_running_sums_of_null_keys_ties_and_null_values(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("", 1, 7), ("a", 1, 1), ("a", 2, 2), (None, 3, 4)],
                               "k string, o int, v long")
    out = running_sums(df, "k", ["o"], {"c": F.col("v"), "r": F.lit(1)}, num_partitions=3)
    assert out.columns == ["k", "o", "v", "c", "r"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(
        [(None, 1, 5, 5, 1), (None, 2, None, 5, 2), (None, 3, 4, 9, 3), ("", 1, 7, 7, 1), ("a", 1, 1, 1, 1), ("a", 2, 2, 3, 2)],
        key=repr)
    assert running_sums(df.limit(0), "k", ["o"], {"c": F.lit(1)}).count() == 0


def test_running_sums_equal_a_window_with_a_hot_key(spark):
    from pyspark.sql import Window
    df = spark.range(0, 30_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
                                       F.xxhash64("id").alias("o"), (F.col("id") % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sums(df, "k", ["o"], {"c": F.col("v")}, num_partitions=16)
    want = df.withColumn("c", F.sum("v").over(w))
    assert got.exceptAll(want).count() == 0 and got.count() == 30_000


def test_parse_runs_once_per_reply(spark, sf):
    parsed = E.parse_replies(Q.V.responses_v(spark, sf))
    p = plan(E.explode_findings(parsed))
    # whole text and the {...} slice: two parse calls, not one per consumer
    assert 1 <= p.count("parseJson") <= 2


def test_review_record_is_one_pass(spark, sf):
    """E14 reads the replies once, parses each at most twice (whole text,
    else its slice) and gathers no distinct lists."""
    from datetime import datetime

    p = plan(E.review_records(Q.parsed(spark, sf), Q.usage_map(), "p", "m", 1, when=datetime(2024, 1, 1)))
    assert len(re.findall(r"FileScan parquet", p)) == 1 and p.count("Exchange ") <= 2
    assert len(re.findall(r"parse_json", p)) <= 2, len(re.findall(r"parse_json", p))
