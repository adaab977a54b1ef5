"""Range joins and chains against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from revlens.operators import history as J
from revlens.operators import ranges as R


def _random(rng, n, far):
    rows = []
    for i in range(n):
        lo = rng.randint(-5, far)
        size = rng.choice([0, 0, 1, 2, 7, 8, rng.randint(0, far), 1 << 26 if rng.random() < 0.05 else 3])
        rows.append((rng.choice(["a", "b", None]), lo, rng.choice([lo + size] * 9 + [None, lo - 1]), i))
    return rows


@pytest.mark.parametrize("slack", [0, 2])
def test_overlap_join(spark, slack):
    rng = random.Random(slack)
    a, b = _random(rng, 150, 300), _random(rng, 150, 300)
    left = spark.createDataFrame(a, "k string, lo long, hi long, i long")
    right = spark.createDataFrame(b, "k string, lo2 int, hi2 int, j long")
    got = sorted((r["i"], r["j"]) for r in R.overlap_join(left, right, ["k"], ("lo", "hi"), ("lo2", "hi2"), slack).collect())
    ok = lambda r: r[2] is not None and r[1] <= r[2]
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and ok(x) and ok(y) and x[1] <= y[2] + slack and y[1] <= x[2] + slack)
    assert got == want          # each pair once


def test_no_nested_loop(spark, sf):
    from revlens.plans import queries as Q

    for q in (Q.j2_finding_history, Q.j5_model_agreement):
        p = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("NestedLoop|CartesianProduct", p)


@pytest.mark.parametrize("slack", [0, 3])
def test_chains(spark, slack):
    rng = random.Random(slack)
    rows = _random(rng, 400, 2000) + [("hot", i * 3, i * 3 + (i % 5), 1000 + i) for i in range(800)]
    got = R.range_groups(spark.createDataFrame(rows, "k string, lo long, hi long, i long").repartition(6), ["k"], "lo", "hi", slack)
    have = {r["i"]: r["range_group"] for r in got.collect()}
    assert len(have) == len(rows)
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k and r[2] is not None and r[1] <= r[2]), key=lambda r: (r[1], r[2]))
        group, reach = 0, None
        for r in mine:
            if reach is None or r[1] > reach + slack:
                group += 1
            reach = r[2] if reach is None else max(reach, r[2])
            assert have[r[3]] == group
    assert all(have[r[3]] is None for r in rows if r[2] is None or r[1] > r[2])


def test_moved_findings_persist(spark):
    cols = "project string, file string, category string, title string, severity string, line long, line_end long"
    then = [("p", "a", "c", "t", "High", 10, None), ("p", "a", "c", "t", "High", 50, 60), ("p", "b", "c", "t", "Low", 1, 1), ("p", "a", "c", "u", "Low", None, None)]
    now = [("p", "a", "c", "t", "High", 12, 13), ("p", "a", "c", "t", "High", 55, 80), ("p", "b", "c", "t", "Low", 9, None), ("p", "a", "c", "u", "Low", None, None)]
    rows = J.finding_history(spark.createDataFrame(now, cols), spark.createDataFrame(then, cols)).collect()
    assert sorted((r["file"], r["title"], r["lo"], r["state"]) for r in rows) == [
        ("a", "t", 12, "persisting"), ("a", "t", 55, "persisting"), ("a", "u", 0, "persisting"), ("b", "t", 1, "fixed"), ("b", "t", 9, "new")]
    agreed = J.model_agreement(spark.createDataFrame([("p", "a", "c", "x", 1, 5), ("p", "a", "c", "y", 5, None), ("p", "a", "c", "x", 5, 6), ("p", "a", "d", "y", 1, 9)],
                                                     "project string, file string, category string, model string, line long, line_end long"))
    assert sorted(tuple(r) for r in agreed.collect()) == [("p", "a", "c", 1, 6, 2, 3), ("p", "a", "d", 1, 9, 1, 1)]
    assert agreed.where(F.col("models") > 1).count() == 1


def test_only_levels_of_the_other_table(spark):
    """Short ranges on both sides lie in few bins, not in those of all levels."""
    short = spark.createDataFrame([("k", i, i + 2) for i in range(0, 400, 4)], "k string, _lo long, _hi long")
    levels = R._levels(short)
    assert levels == [2] and R._bins(short, levels).count() == 0
    long = spark.createDataFrame([("k", 0, 1 << 20)], "k string, _lo long, _hi long")
    assert R._bins(short, R._levels(long)).count() == 100


def test_the_rules_run_once_a_side(spark, sf):
    """The joins of the history read written ranges, not the documents."""
    from revlens.plans import queries as Q

    plan = Q.j2_finding_history(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "rlike" not in plan.lower()
