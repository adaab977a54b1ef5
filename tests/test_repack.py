"""Packing again after changes equals packing all."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import chunking as D
from revlens.operators import corpus as C
from revlens.operators import history as J
from revlens.operators.packing import narrow_files, place_files
from revlens.operators.repack import repack

BUDGET = 1500
WIDTH = max(1000, 3 * BUDGET)


def _corpus(spark, files):
    return C.corpus_from_table(spark.createDataFrame([(p, r, t) for (p, r), t in files.items()] or [],
                                                     "project string, relative string, text string"))


def _run(spark, before, after):
    old, new = _corpus(spark, before), _corpus(spark, after)
    changes = [(p, r, "removed" if (p, r) not in after else "added" if (p, r) not in before else "changed")
               for p, r in set(before) | set(after) if before.get((p, r)) != after.get((p, r))]
    got = repack(new, spark.createDataFrame(changes, "project string, relative string, change string"),
                 place_files(narrow_files(old), BUDGET, WIDTH), D.chunk_headers(D.pack_chunks(old, BUDGET)), BUDGET)
    cols = ["project", "chunk_id", "n_files", "tokens", "signature"]
    rows = got.chunks.collect()
    want = sorted((tuple(r) for r in D.chunk_headers(D.pack_chunks(new, BUDGET)).select(*cols).collect()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == want
    return rows, {tuple(r) for r in got.touched.collect()}


def _text(rng):
    return "x" * rng.choice([100, 700, 1500, 2600, 5200, 5251, rng.randint(1, 6000), 9000, 21_000])


@pytest.mark.parametrize("seed", [0, 2])
def test_equals_packing_all(spark, seed):
    rng = random.Random(seed)
    before = {(p, f"f{i:03d}.py"): _text(rng) for p in ("a", "B", None) for i in range(0, 120, 2)}
    after = dict(before)
    for key in rng.sample(sorted(before, key=str), 7):
        if rng.random() < 0.4:
            del after[key]
        else:
            after[key] = _text(rng)
    for _ in range(4):
        after[rng.choice(["a", "B", None]), f"f{rng.randrange(-1, 121):03d}{rng.choice(['', 'x'])}.py"] = _text(rng)
    after["new project", "z.py"] = "y" * 400
    after["new project", "big.py"] = "y" * 40_000
    after = {k: v for k, v in after.items() if k[0] != "B"} if seed == 2 else after         # a project goes
    rows, touched = _run(spark, before, after)
    assert any(r["kept"] for r in rows) and len(touched) < len(after)


def test_the_first_file_of_a_chunk_shrinks(spark):
    """It then fits into the chunk before, which no change lies in."""
    before = {("p", f"{i}.py"): "x" * n for i, n in enumerate([3500, 3500, 1700, 3500, 3400, 1000, 3500])}
    after = dict(before) | {("p", "1.py"): "x" * 100}
    _run(spark, before, after)
    del after["p", "1.py"]
    _run(spark, before, after)


def test_few_files_are_touched(spark):
    """A change in a long project is packed again up to where the chunks meet."""
    rng = random.Random(9)
    before = {("p", f"f{i:05d}.py"): "x" * rng.randint(200, 3000) for i in range(1500)}
    after = dict(before) | {("p", "f00700.py"): "x" * 5000, ("p", "f00100a.py"): "x" * 900}
    rows, touched = _run(spark, before, after)
    assert len(touched) < 200 and sum(r["kept"] for r in rows) > 0.85 * len(rows)
    rows, touched = _run(spark, before, before)     # nothing changed
    assert not touched and all(r["kept"] for r in rows)


def test_changes_of_snapshots(spark, sf):
    from revlens.plans import queries as Q

    cur, old = Q.current_docs(spark, sf), Q.snapshot_docs(spark, sf)
    got = repack(cur, J.changed_files(cur, old), place_files(narrow_files(old), BUDGET, WIDTH), D.chunk_headers(D.pack_chunks(old, BUDGET)), BUDGET)
    want = D.chunk_headers(D.pack_chunks(cur, BUDGET))
    assert got.chunks.drop("kept").exceptAll(want.select(*got.chunks.columns[:-1])).isEmpty() and got.chunks.count() == want.count()
    assert got.chunks.where(F.col("kept")).count() > 0
