"""Reply parsing, dedup, status, scoring hook."""

import json
import random

from pyspark.sql import functions as F

from revlens.operators import review as E
from revlens.operators.scoring import score_chunks


def parse(spark, raws):
    df = spark.createDataFrame([(f"p{i % 2}", i, r) for i, r in enumerate(raws)],
                               "project string, chunk_id bigint, raw string")
    return E.parse_replies(df)


def test_parse_edge_cases(spark):
    raws = ["```JSON\n{\"summary\": \"s\", \"findings\": []}\n```",   # fenced, upper case
            "[{\"a\": 1}]",                                          # array: its {...} slice is an object
            "Here you go: {\"findings\": []} thanks",                 # prose around the object
            "{\"a\": NaN}",                                          # not JSON
            "{\"findings\": null}",                                  # null list: reject the reply
            "{\"positive_points\": \"good\"}",                        # string list: reject the reply
            "",                                                      # empty
            "   "]
    rows = parse(spark, raws).orderBy("chunk_id").collect()
    assert [r["ok"] for r in rows] == [True, True, True, False, False, False, False, False]
    assert rows[6]["error"] == "AI provider returned an empty review response."
    assert rows[3]["error"].startswith("The AI response was not valid JSON. Response preview: '")


def test_findings_key_text(spark):
    reply = json.dumps({"findings": [
        {"category": "Bug", "severity": "High", "file": "a.py", "line": 12, "title": "t"},
        {"category": "Bug", "severity": "High", "file": "a.py", "line": 12, "title": "t"},    # repeat
        {"category": "Bug", "severity": None, "file": "a.py", "title": "t"},                  # null / missing
        {"category": "Bug", "severity": "Low", "file": "b.py", "line": "12-15", "line_end": 20, "title": "u"},
        "not an object"]})
    f = E.explode_findings(parse(spark, [reply])).orderBy("pos").collect()
    assert len(f) == 4
    assert f[2]["k_severity"] == "None" and f[2]["k_line"] == "" and f[2]["severity_missing"] is False
    assert f[3]["line"] is None and f[3]["line_raw"] == "12-15" and f[3]["line_end"] == 20
    u = E.dedup_findings(E.explode_findings(parse(spark, [reply])))
    assert u.count() == 3
    assert E.dedup_findings(u.drop("dedup_key")).count() == 3                      # idempotent
    lab = {r["pos"]: r["line_label"] for r in E.with_line_label(u).collect()}
    assert lab[0] == "Line 12" and lab[2] == "" and lab[3] == "Line 12-15-20"


def test_status_precedence(spark):
    replies = [json.dumps({"findings": [{"severity": "Critical", "title": "x"}]}),     # p0: critical
               json.dumps({"findings": []}),                                             # p1 ...
               "garbage"]                                                                # p0 failure
    p = parse(spark, replies)
    u = E.dedup_findings(E.explode_findings(p))
    st = {r["project"]: r["overall_status"] for r in E.overall_status(p, u, p.where(~F.col("ok"))).collect()}
    assert st == {"p0": "critical", "p1": "positive"}
    p2 = parse(spark, ["{}", "oops"])        # p0 ok without findings, p1 failed
    u2 = E.dedup_findings(E.explode_findings(p2))
    st2 = {r["project"]: r["overall_status"] for r in E.overall_status(p2, u2, p2.where(~F.col("ok"))).collect()}
    assert st2 == {"p0": "positive", "p1": "review_incomplete"}


def test_score_chunks(spark):
    prompts = spark.createDataFrame([("p", i, f"s{i}", f"prompt {i}") for i in range(6)],
                                    "project string, chunk_id bigint, signature string, prompt string")

    def fn(batch):
        return [(json.dumps({"summary": p}), {"prompt_tokens": len(p), "note": "x"}) for p in batch]

    out = score_chunks(prompts, fn).orderBy("chunk_id").collect()
    assert [json.loads(r["raw"])["summary"] for r in out] == [f"prompt {i}" for i in range(6)]
    assert out[0]["usage"] == {"prompt_tokens": 8.0} and out[0]["error"] is None

    def broken(batch):
        raise RuntimeError("provider down")

    bad = score_chunks(prompts, broken).collect()
    assert len(bad) == 6 and all(r["error"] == "RuntimeError: provider down" for r in bad)


def test_flagship_replies_cover_every_chunk(spark, sf):
    from revlens.operators import chunking as D
    from revlens.plans.review_plan import offline_review

    r = offline_review(spark, sf)
    assert r.replies.count() == r.chunks.count() == r.members.select("project", "chunk_id").distinct().count()
    # every rule hit on a member's own text comes back as a finding of its chunk
    mt = D.member_texts(r.files, 3100)
    hits = E.rule_findings(mt).select("project", "file", "line", "title").distinct().count()
    got = E.explode_findings(r.parsed).select("project", "file", "line", "title").distinct().count()
    assert got == hits
    assert r.parsed.where(~F.col("ok")).count() == 0


def test_pending_empty_after_full_completion(spark, sf):
    from revlens.operators import attempts as A
    from revlens.operators import chunking as D
    from revlens.plans.queries import reviewable

    heads = D.chunk_headers(D.pack_chunks(reviewable(spark, sf), 3100))
    assert A.pending_chunks(heads, heads).count() == 0
    half = heads.where(F.col("chunk_id") % 2 == 0)
    assert A.pending_chunks(heads, half).count() == heads.count() - half.count()


def test_failed_ledger_with_members(spark):
    replies = spark.createDataFrame([("p", 1, "{}"), ("p", 2, "oops"), ("q", 1, "")],
                                    "project string, chunk_id bigint, raw string")
    members = spark.createDataFrame([("p", 2, 1, "b.py", 30), ("p", 2, 0, "a.py", 10), ("p", 1, 0, "c.py", 5)],
                                    "project string, chunk_id bigint, pos int, relative string, tokens bigint")
    led = {(r["project"], r["chunk_id"]): r for r in E.failed_ledger(E.parse_replies(replies), members).collect()}
    assert set(led) == {("p", 2), ("q", 1)}
    assert led[("p", 2)]["files"] == ["a.py", "b.py"] and led[("p", 2)]["tokens"] == 40
    assert led[("q", 1)]["files"] is None and led[("q", 1)]["error"].startswith("AI provider returned an empty")


def test_key_text_is_python_str(spark):
    values = ["12", "12.0", "true", '"true"', "null", "0.5", "-2.50", "1e5", "1e16", "1.25e-7", "0.0001", "123456789.125",
              "12345678901234567890123", '"a"', "1e15"]
    raw = json.dumps({"findings": [{"title": "@" + str(i)} for i in range(len(values))]})
    for i, v in reversed(list(enumerate(values))):
        raw = raw.replace(f'"@{i}"', v)
    got = [r["k_title"] for r in E.explode_findings(parse(spark, [raw])).orderBy("pos").collect()]
    assert got == [str(json.loads(v)) for v in values]
    assert len(set(got)) == len(values)


def test_fences_behind_unicode_blanks(spark):
    raws = ["\u00a0", "\u3000```json\u2003{\"findings\": []}\u00a0```\u2028", "\x1f\x85"]
    rows = parse(spark, raws).orderBy("chunk_id").collect()
    assert [r["ok"] for r in rows] == [False, True, False]
    assert rows[0]["error"] == rows[2]["error"] == "AI provider returned an empty review response."


def _python_chain(text):
    """The reviewed program's rule: the whole text, else its outermost braces."""
    lo, hi = text.find("{"), text.rfind("}")
    for part in [text] + ([text[lo:hi + 1]] if 0 <= lo < hi else []):
        try:
            got = json.loads(part)
            if isinstance(got, dict):
                return got
        except (json.JSONDecodeError, RecursionError):
            pass
    return None


def test_strict_is_python(spark):
    rng = random.Random(5)
    base = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN, "b": [Infinity, -Infinity]}', '{}', '[{"a": 1}]', '1', '"x"', '{"a": "}"}', '{"a": "\\ud800"}',
            '{"a": 1e400}', '{"a": 01}', "{'a': 1}", '{"a": 1,}', '{"a": "\t"}', '{"a": {"b": [1, {"c": null}]}}', '{"a": true, "n": 12345678901234567890123}',
            '{"a": 1.50}', '{"a": ' + "7" * 45 + "}", '{"a": "\\u00e9\u00e9"}']
    junk = ["", " ", "{}", "]", "}", ", {}", "] {", "text", "\n", ',', '"x": 1}', ", 2", '],"x":[1', '},{"y":2', "[", '{"x":', "\ufeff"]
    texts = base + ['{"a":' * 400 + "1" + "}" * 400]
    for _ in range(700):
        t = rng.choice(junk) + rng.choice(base) + rng.choice(junk) + (rng.choice(base) if rng.random() < 0.2 else "")
        if rng.random() < 0.3 and t:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "{", "}", '"', ",", "]", "N"]) + t[i + rng.randint(0, 1):]
        texts.append(t)
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "project string, chunk_id bigint, raw string")
    rows = {r["chunk_id"]: r for r in E.parse_replies(df, strict=True).select("chunk_id", "cleaned", F.to_json("v").alias("j"),
                                                                           F.col("v").isNotNull().alias("parsed"), "ok").collect()}

    def plain(x):
        if isinstance(x, float):
            return str(x) if x != x or abs(x) == float("inf") else float(x)
        if isinstance(x, int) and abs(x) >= 10**38:
            return str(x)
        if isinstance(x, str):
            return x.encode("utf-8", "replace").decode()
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    for i, t in enumerate(texts):
        want = _python_chain(rows[i]["cleaned"])
        assert rows[i]["parsed"] == (want is not None), t
        if want is not None:
            assert plain(json.loads(rows[i]["j"])) == plain(want), t


def test_strict_sends_few_rows_to_python(spark):
    good = E.parse_replies(spark.createDataFrame([("p", 1, '{"findings": []}'), ("p", 2, "nothing"), ("p", 3, "")],
                                                 "project string, chunk_id bigint, raw string"), strict=True)
    p = good._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in p and good.where("ok").count() == 1
