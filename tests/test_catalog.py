"""Model-list payload shapes (G1, G2) and ranking."""

import json

import pytest

from revlens.operators import catalog as G


def normalize(spark, rows):
    df = spark.createDataFrame([(i, p, json.dumps(x) if not isinstance(x, str) else x)
                                for i, (p, x) in enumerate(rows)], "payload_id long, provider string, payload string")
    return sorted((r["provider"], r["id"], r["name"], r["context"]) for r in G.normalize_catalog(df).collect())


def test_payload_shapes(spark):
    rows = [
        ("gemini", {"models": [
            {"name": "models/gemini-pro", "displayName": "Gemini Pro", "inputTokenLimit": 30720,
             "supportedGenerationMethods": ["generateContent", "countTokens"]},
            {"name": "models/embedding-001", "supportedGenerationMethods": ["embedContent"]},
            {"name": "models/plain"}]}),
        ("ollama", {"models": [{"name": "llama3:latest"}, {"model": "qwen"}, {"size": 1}]}),
        ("generic", [{"id": "a", "context_length": 0, "max_input_tokens": 1000},
                     {"name": "b", "active": False}, {"model": "c", "archived": True},
                     {"id": "", "name": "d", "display_name": "Dee", "top_provider": {"context_length": 77}},
                     "not an object"]),
        ("generic", {"models": [{"id": "unread"}]}),              # no "data": an empty list, models unread
        ("generic", {"data": None, "models": [{"id": "m2", "limits": {"context": 5}}]}),
        ("generic", "not json"),
    ]
    assert normalize(spark, rows) == sorted([
        ("gemini", "gemini-pro", "Gemini Pro", 30720),
        ("gemini", "plain", "plain", None),
        ("ollama", "llama3:latest", "llama3:latest", None),
        ("ollama", "qwen", "qwen", None),
        ("generic", "a", "a", 1000),
        ("generic", "d", "Dee", 77),
        ("generic", "m2", "m2", 5),
    ], key=lambda t: (t[0], t[1], t[2], t[3] or 0))


def test_rank_search_page(spark):
    items = [{"id": f"m{i:02d}", "context_length": (i % 5 + 1) * 1000} for i in range(60)]
    items += [{"id": "text-embed-large", "context_length": 999999}, {"id": "Whisper-1"}]
    df = spark.createDataFrame([(1, "generic", json.dumps(items))], "payload_id long, provider string, payload string")
    ranked = G.rank_models(G.normalize_catalog(df))
    order = [r["id"] for r in ranked.orderBy("model_rank").collect()]
    assert order[-2:] == ["text-embed-large", "Whisper-1"]        # non-chat last, larger context first
    assert order[0] == "m04" and order[:3] == ["m04", "m09", "m14"]
    page = [r["id"] for r in G.model_page(ranked, 1).orderBy("model_rank").collect()]
    assert page == order[25:50]
    hits = G.search_models(ranked, "M1").orderBy("match_rank").collect()
    assert len(hits) == 10 and all("m1" in r["id"] for r in hits)
    assert len(G.search_models(ranked, "m", limit=50).collect()) == 50


def test_catalog_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """Flat or in sub-folders; no list of the files in the plan."""
    for name in ("a/1.json", "a/2.json", "a/deep/3.json", "a/note.txt", "a/_4.json", "b/0/5.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps([{"id": name}]))
    folders = spark.createDataFrame([("generic", f"{tmp_path}/a"), ("other", f"file:{tmp_path}/b")], "provider string, folder string")
    read = G.read_catalogs(folders)
    assert "FileScan text" not in read._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["provider"], json.loads(r["payload"])[0]["id"]) for r in read.collect()) == [
        ("generic", "a/1.json"), ("generic", "a/2.json"), ("generic", "a/deep/3.json"), ("other", "b/0/5.json")]
    for path, n in ((f"{tmp_path}/a/*.json", 2), (f"{tmp_path}/a/", 3), (f"{tmp_path}/a/1.json", 1)):
        assert G.read_catalog(spark, path, "generic").count() == n
    with pytest.raises(Exception, match="not listed"):
        G.read_catalog(spark, f"{tmp_path}/none/*.json", "generic").collect()


def test_payloads_are_dealt_and_parsed_once(spark):
    rows = [(i, "generic", json.dumps([{"id": f"m{i}"}])) for i in range(200)]
    df = spark.createDataFrame(rows, "payload_id long, provider string, payload string").coalesce(1)
    models = G.normalize_catalog(df)
    assert models.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the order reads models that are written, not the payloads
    assert "parse_json" not in G.rank_models(models)._jdf.queryExecution().optimizedPlan().toString()
