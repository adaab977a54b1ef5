"""Source mixing: targets by rounds, systematic sampling by one loop."""

import random

import pytest

from revlens.llm import mixing


def _check(docs, rows, **how):
    got = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"]) for r in mixing.mix(docs, **how).collect()), key=str)
    want = sorted(((d, n, s, round(t, 6), c) for d, n, s, t, c in mixing.brute_force(rows, **how)), key=str)
    assert got == want
    return got


def test_odd_rows(docs, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    _check(docs, rows)
    assert mixing.mix(none).collect() == []
    assert mixing.emit(none).columns == none.columns and mixing.emit(none).collect() == []


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (3, 7, 2, 11)])
def test_targets_and_copies(spark, weights):
    rng = random.Random(len(weights))
    names = ["a", "B", "é", "日", "😀", "", None, "empty"]
    rows = [(i, None if rng.random() < 0.05 else " ".join(["w"] * int(rng.paretovariate(0.9)))[:4000], rng.choice(names[:7]) if i % 3 else "hot")
            for i in range(600)] + [(1000 + i, " ", "empty") for i in range(5)] + [(5, "twice", "a")] * 2
    d = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, copies int")
    got = _check(d, rows, weights=weights)
    made = {}
    for r in mixing.mix(d, weights).collect():
        assert 0 <= r["copies"] <= 3
        at = made.setdefault(r["source"], [0, r["target"], 0])
        at[0], at[2] = at[0] + r["copies"] * r["size"], max(at[2], r["size"])
    for taken, target, largest in made.values():
        assert abs(taken - target) <= 2 * largest
    assert abs(sum(t for _, t, _ in made.values()) - sum(n for _, n, *_ in got)) < 1e-6
    again = mixing.mix(d.repartition(5), weights)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, mixing.mix(d, weights).collect()), key=str)


def test_reshared_until_none_is_above(spark):
    # the small source stops at 3 times its size, the excess goes to the others by weight
    rows = [(1, "w " * 10, "a"), (2, "w " * 300, "b"), (3, "w " * 690, "c")]
    t = {r["source"]: r["target"] for r in mixing.source_targets(
        spark.createDataFrame([(s, t.count("w")) for _, t, s in rows], "source string, size long")).collect()}
    assert t["a"] == 30 and t["b"] == pytest.approx(970 * 2 / 3) and t["c"] == pytest.approx(970 / 3)


def test_emit_keeps_rows(spark):
    rows = [(i % 40, f"text {i % 7} " * (i % 5), f"s{i % 3}", i) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plan = {}
    for r in mixing.mix(d, keep=True).collect():
        plan[tuple(r["row"])] = r["copies"]
    out = [tuple(r) for r in mixing.emit(d).collect()]
    assert mixing.emit(d).columns == d.columns and set(out) <= set(rows)
    assert {r: out.count(r) for r in rows} == plan


def test_weights_are_whole_numbers(docs):
    with pytest.raises(ValueError):
        mixing.mix(docs, weights=(0.5, 1))
