import corpus_pipeline
from revlens.llm import decontaminate, simhash, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    seen = {}
    from revlens.llm.components import written

    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        before, cur = cur, written(stage(spark, cur, sf), f"test-{name}")
        seen[name] = (before, cur)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert cur.columns == docs.columns
    before, after = seen["toxicity"]
    bad = toxicity.score(before, toxicity.train(before, labels)).where("predicted = 1")
    assert after.count() == before.count() - bad.count()
    before, after = seen["simhash_near_dedup"]
    assert {r[0] for r in after.select("doc_id").collect()} == {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    before, after = seen["benchmark_decontamination"]
    hit = decontaminate.digest(decontaminate.find_spans(before, bench)).where("contaminated").count()
    assert hit > 0
    changed = before.alias("a").join(after.alias("b"), "doc_id").where("not (a.text <=> b.text)").count()
    assert changed + before.count() - after.count() == hit
    assert after.where("n_chars != length(text)").count() == 0
    before, after = seen["sentencepiece"]
    assert after.count() == before.count() and after.where("not round_trip").count() == 0


def test_run_equals_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
