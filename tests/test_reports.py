"""Report pages: order over many writer tasks, names, repeated attempts."""

import json

import pytest
from pyspark.sql import functions as F

from revlens.sources import report_files as R
from revlens.sources.io import report_names


def _rows(spark, n):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot.html").otherwise(F.concat(F.lit("p"), (F.col("id") % 7).cast("string"), F.lit(".html"))).alias("report"),
        (F.col("id") % 4).cast("int").alias("section"), F.col("id").alias("seq"),
        F.when(F.col("id") % 11 == 0, "").otherwise(F.concat(F.lit("é "), F.col("id").cast("string"))).alias("html"))


@pytest.mark.parametrize("tasks", [1, 4, 16])
def test_pages_are_whole_and_in_order(spark, tmp_path, tasks):
    rows = _rows(spark, 3000)
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["section"], r["seq"])):
        want.setdefault(r["report"], []).append(r["html"])
    done = R.write_pages(rows.repartition(9), f"file:{tmp_path}/out", tasks).first()
    got = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert got == {n: "\n".join(v) for n, v in want.items()}            # and no parts are left
    assert (done["reports"], done["bytes"]) == (len(want), sum(len(t.encode()) for t in got.values()))
    R.write_pages(rows.where("seq < 10"), str(tmp_path / "out"), tasks)      # written again
    assert (tmp_path / "out" / "hot.html").read_text().count("\n") == 3


def test_page_that_begins_with_empty_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, i, h) for i, h in enumerate(["", None, "x", ""])], "report string, section int, seq long, html string")
    R.write_pages(rows, str(tmp_path), 2)
    assert (tmp_path / "a").read_text() == "\n\nx\n"
    R.write_pages(rows.where("false"), str(tmp_path / "none"), 2)
    assert list((tmp_path / "none").iterdir()) == []


def test_parts_of_other_attempts_are_not_read(spark, tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"report": "a", "section": 0, "seq": 1, "html": "one"}, {"report": "b", "section": 0, "seq": 1, "html": "b"}])
    w = R._PartWriter(str(tmp_path))
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))      # the same task ran twice
    w.commit([kept, R._Done(None), None])
    assert (tmp_path / "committed").read_text() == kept.parts != lost.parts
    parts = R._read_lists(spark, str(tmp_path), [kept.parts]).collect()
    assert [(p["report"], p["bytes"]) for p in parts] == [("a", 3), ("b", 1)]
    assert json.loads((tmp_path / lost.parts).read_text().split("\n")[0])["part"] not in {p["part"] for p in parts}
    w.abort([kept])
    assert list(tmp_path.iterdir()) == []


def test_projects_with_one_safe_name(spark):
    r = spark.createDataFrame([("a b", "p", "m"), ("a_b", "p", "m"), ("c", "p", "m")], "project string, provider string, model string")
    names = [x["report"] for x in report_names(r).collect()]
    assert len(set(names)) == 3 and sum(n.startswith("a_b-p-m-") for n in names) == 1
