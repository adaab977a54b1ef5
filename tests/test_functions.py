"""Golden values of the column functions, budgets, hygiene and attempts."""

from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators import attempts as A
from revlens.operators import catalog as G
from revlens.operators import chunking as D
from revlens.operators import hygiene as H


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def py_split_loc(t):
    return len(t.splitlines()) or 1


def test_file_loc(spark):
    assert one(spark, X.file_loc, "") == 0
    assert one(spark, X.file_loc, "a") == 1
    assert one(spark, X.file_loc, "a\n") == 2          # a trailing newline adds one
    assert one(spark, X.file_loc, "a\nb\n\n") == 4


def test_part_loc_matches_splitlines(spark):
    samples = ["", "a", "a\n", "a\r\nb", "a\rb\x0bc\x0cd\x1ce\x1df\x1eg\x85h i j", "x\n\n", "\r\n"]
    rows = spark.createDataFrame([(s,) for s in samples], "v string").select(X.part_loc("v").alias("r")).collect()
    assert [r["r"] for r in rows] == [py_split_loc(s) for s in samples]


def test_token_estimate(spark):
    for n in (0, 1, 2, 3, 4, 7, 10, 11, 35, 3499, 10001):
        assert one(spark, X.token_estimate, "x" * n) == max(1, round(n / 3.5))
    assert one(spark, X.token_estimate, "\U0001F600" * 7) == 2      # code points, not bytes


def test_human_size(spark):
    def fmt(value):
        n = float(value)
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if n < 1024 or unit == "TB":
                return f"{n:.2f} {unit}"
            n /= 1024
    for v in (0, 1, 1023, 1024, 1152, 1664, 2816, 1536 * 1024, 1_678_000, 5 * 1024 ** 4, 3 * 1024 ** 5):
        assert one(spark, X.human_size, v, "bigint") == fmt(v), v


def test_safe_name(spark):
    assert one(spark, X.safe_name, "My Project (v2)!") == "My_Project_v2"
    assert one(spark, X.safe_name, "___") == "project"
    assert one(spark, X.safe_name, "openai/gpt-oss-20b") == "openai_gpt-oss-20b"


def test_suffix(spark):
    names = ["a.py", ".eslintrc.json", ".bashrc", "file.", "Dockerfile", "a.b.TXT", "..x"]
    got = [r["r"] for r in spark.createDataFrame([(n,) for n in names], "v string")
           .select(X.suffix("v").alias("r")).collect()]
    assert got == [".py", ".json", "", "", "", ".TXT", ".x"]


def test_strip_fences_and_escape(spark):
    assert one(spark, X.strip_fences, "  ```JSON\n{\"a\":1}\n```  ") == '{"a":1}'
    assert one(spark, X.strip_fences, "```\n{}\n```") == "{}"
    assert one(spark, X.html_escape, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"


def test_severity_rank(spark):
    vals = ["Critical", "High", "Medium", "Low", "Info", "high", None]
    got = [r["r"] for r in spark.createDataFrame([(v,) for v in vals], "v string")
           .select(X.severity_rank("v").alias("r")).collect()]
    assert got == [0, 1, 2, 3, 4, 99, 99]


def test_budgets_readme_numbers(spark):
    df = spark.createDataFrame([(8000, 131072, None), (None, 131072, None), (1000, 8192, None), (500, 8192, "manual")],
                               "tpm bigint, context bigint, source string")
    rows = D.rate_policy(df, source="source").collect()
    assert (rows[0]["budget"], round(rows[0]["delay"], 2)) == (3100, 37.26)
    assert (rows[1]["budget"], rows[1]["delay"], rows[1]["policy_source"]) == (65536, 0.0, "context_only")
    assert (rows[2]["budget"], rows[2]["delay"]) == (1200, 65.0)
    assert rows[3]["policy_tpm"] == 1000                      # manual tpm floored at 1,000
    assert one(spark, D.context_budget, 1_000_000, "bigint") == 100_000
    assert one(spark, D.context_budget, 2_000, "bigint") == 1_500


def test_sanitize_mask_fingerprint(spark):
    import hashlib
    raw = ["  \"Bearer sk-abc​def\"  ", "'xyz'", "", None, "12345678", "123456789", "gsk_" + "a" * 15,
           "gsk_" + "a" * 16, "ＡＢＣ"]
    df = spark.createDataFrame([(r,) for r in raw], "v string").select(H.sanitize(F.col("v")).alias("k"))
    df = df.select("k", H.mask(F.col("k")).alias("m"), H.fingerprint(F.col("k")).alias("f"))
    rows = df.collect()
    assert rows[0]["k"] == "sk-abcdef"                        # zero-width removed (Cf), quotes, Bearer
    assert rows[1]["k"] == "xyz"
    assert rows[2]["m"] == "NOT SET" and rows[3]["m"] == "NOT SET" and rows[2]["f"] == "empty"
    assert rows[4]["m"] == "SET (8 chars)"
    assert rows[5]["m"] == "1234...6789 (9 chars)"
    assert rows[8]["k"] == "ABC"                              # NFKC
    assert rows[0]["f"] == hashlib.sha256(b"sk-abcdef").hexdigest()[:10]


def test_format_check(spark):
    df = spark.createDataFrame([("groq", ""), ("groq", "gsk_" + "a" * 15), ("groq", "gsk_" + "a" * 16),
                                ("groq", "sk-" + "b" * 20), ("ollama", "z" * 25)], "provider string, key string")
    rows = H.format_check(df, "provider", "key").collect()
    assert [r["valid"] for r in rows] == [False, False, True, True, True]
    assert rows[0]["messages"] == ["API key is empty."]
    assert "too short (19 characters)" in rows[1]["messages"][0]
    assert rows[3]["prefix_ok"] is False and len(rows[3]["messages"]) == 2
    assert rows[4]["prefix_ok"] is True                       # no known prefix: nothing to check


def test_context_lookup(spark):
    req = spark.createDataFrame([("gpt-5", None), ("GPT-5", None), ("unknown-model", None), ("gpt-5", 12345),
                                 (" llama3-8b-8192 ", 0)], "model string, live bigint")
    rows = G.context_lookup(req, "model", live="live").collect()
    got = [(r["context_assumed"], r["context_source"]) for r in rows]
    assert got == [(400000, "exact"), (400000, "case_insensitive"), (8192, "default"), (12345, "live"),
                   (8192, "exact")]


def test_attempt_rules(spark):
    df = spark.createDataFrame(
        [(429, "", None, 1, "p", 1), (None, "Connection reset by peer", None, 2, "p", 1),
         (400, "maximum context exceeded", None, 1, "p", 2), (503, "", 500.0, 1, "p", 3),
         (503, "", None, 5, "p", 4), (200, "", None, 1, "p", 5), (401, "", None, 1, "p", 6)],
        "status int, detail string, retry_after double, attempt int, provider string, chunk_id bigint")
    rows = A.plan_attempts(df, with_jitter=False).collect()
    assert [r["action"] for r in rows] == ["retry", "retry", "split", "retry", "fail", "done", "fail"]
    assert rows[0]["wait_sec"] == 1.0 and rows[1]["wait_sec"] == 2.0
    assert rows[3]["wait_sec"] == 120.0                       # Retry-After clamped
    assert rows[6]["hint"].startswith("Authentication failed")
    j = A.plan_attempts(df).collect()
    assert all(0 <= r["wait_sec"] - 2 ** (r["attempt"] - 1) < 0.75 for r in j if r["action"] == "retry"
               and r["retry_after"] is None)


def test_scan_secrets_emits_only_masked_forms(spark):
    secret1 = "sk-ant-" + "A1b2" * 8
    secret2 = "gsk_" + "Zz9_" * 6
    text = (f'config:\n  api_key = "{secret1}"\n  password: \'hunter2hunter2\'\n'
            f"export GROQ={secret2}\nshort token = \"abc\"\n")
    df = spark.createDataFrame([(1, "proj", text)], "doc_id long, source string, text string")
    rows = H.scan_secrets(df).orderBy("hit_no").collect()
    kinds = [r["kind"] for r in rows]
    assert kinds.count("assignment") == 2 and kinds.count("prefix") == 2
    flat = " ".join(str(v) for r in rows for v in r.asDict().values())
    for s in (secret1, secret2, "hunter2hunter2"):
        assert s not in flat
    assert any(r["masked"] == f"{secret1[:4]}...{secret1[-4:]} ({len(secret1)} chars)" for r in rows)
