"""Registered queries: one callable (spark, data_dir) -> DataFrame per
the derived views of ``sources.fixtures``) over whole tables and texts.

Output columns are aliased to the names the oracle SQL uses.  Large text
columns are compared through ``sha2`` / ``length`` so the check stays exact
without moving whole documents through the comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.operators import chunking as D
from revlens.operators import corpus as C
from revlens.operators import review as E
from revlens.sources import fixtures as V

BUDGET = 3_100          # the README example: tpm 8,000 on a 131,072 context
DELAY = 37.26
SPLIT_WIDTH = 4_500
WHEN = datetime(2024, 1, 2, 3, 4, 5)
PROVIDER, MODEL, CONTEXT = "groq", "openai/gpt-oss-20b", 131_072

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- helpers
def files(spark: SparkSession, d: str) -> DataFrame:
    return C.corpus_from_table(V.files_v(spark, d))


def reviewable(spark: SparkSession, d: str) -> DataFrame:
    return C.reviewable(files(spark, d))


def members(spark: SparkSession, d: str) -> DataFrame:
    return D.pack_chunks(reviewable(spark, d), BUDGET)


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return E.parse_replies(V.responses_v(spark, d))


def usage_map() -> F.Column:
    return F.create_map(F.lit("prompt_tokens"), F.col("prompt_tokens").cast("double"),
                        F.lit("completion_tokens"), F.col("completion_tokens").cast("double"))


def unique_findings(spark: SparkSession, d: str) -> DataFrame:
    return E.dedup_findings(E.explode_findings(parsed(spark, d)))


def unique_keys(spark: SparkSession, d: str) -> DataFrame:
    """Unique findings with the columns that ranks, counts and labels read;
    texts like the evidence stay out of the exchanges."""
    f = E.explode_findings(parsed(spark, d))
    return E.dedup_findings(f.select("project", "chunk_id", "pos", "severity", "severity_missing", "line", "line_raw", "line_end_raw",
                                     "k_category", "k_severity", "k_file", "k_line", "k_title"))


FINDING_OUT = ["project", "chunk_id", "pos", "category", "severity", "file", "line", "line_raw", "line_end",
               "title", "evidence", "why", "fix", "confidence", "k_category", "k_severity", "k_file", "k_line",
               "k_title"]


# ---------------------------------------------------------------- A, B, C
def a3_corpus_from_table(spark, d):
    return files(spark, d).drop("text")


def a1_scan_corpus(spark, d):
    """The corpus view written out as a source tree (one folder per
    project) and scanned back: pruning, name filter, decode, statistics."""
    from revlens.plans.session import scratch_path
    from revlens.sources.corpus_tree import scan_trees, write_tree
    root = scratch_path(spark, "tree")
    v = V.files_v(spark, d)
    write_tree(v, root)
    roots = v.select("project").distinct().withColumn("root", F.concat(F.lit(root + "/"), "project"))
    return scan_trees(roots).select("project", "relative", "ext", "size", "lines", "tokens", "error")


def a2_scan_file(spark, d):
    """Every file of the tree named by its path, reviewable or not; every
    fifth one is looked for where it is not."""
    from revlens.plans.session import scratch_path
    from revlens.sources.corpus_tree import read_paths, write_tree
    root = scratch_path(spark, "files")
    v = V.files_v(spark, d).withColumn("away", F.length("text") % 5 == 0)
    write_tree(v.where("not away"), root)
    paths = v.select(F.concat(F.lit(root + "/"), "project", F.lit("/"), "relative").alias("path"))
    return read_paths(paths).select(
        F.col("project").alias("folder"), F.element_at(F.split("path", "/"), -3).alias("above"), "relative",
        F.when(F.col("error").isNull(), F.col("size")).alias("size"), "lines", "tokens",
        F.when(F.col("error").startswith("not a reviewable name"), "name").when(F.col("error").isNotNull(), "missing")
        .otherwise("read").alias("state"))


def a4_read_replies(spark, d):
    """Replies written as JSON lines (schema of the reply log) and read back."""
    from revlens.plans.session import scratch_path
    from revlens.sources.io import read_replies
    path = scratch_path(spark, "replies")
    r = V.responses_v(spark, d)
    r.select("project", "chunk_id", F.lit(None).cast("string").alias("signature"), F.lit(1).alias("attempt"),
             "raw", usage_map().alias("usage")).write.mode("overwrite").json(path)
    back = read_replies(spark, path)
    return back.select("project", "chunk_id", "attempt", "raw",
                       F.col("usage")["prompt_tokens"].alias("usage_prompt"))


def a5_read_catalog(spark, d):
    """Model-list payloads written one file each (per provider folder, a
    thousand ids to a sub-folder), read back whole and normalised."""
    from revlens.operators import catalog as G
    from revlens.plans.session import scratch_path, shuffle_partitions
    from revlens.sources.corpus_tree import write_tree
    root = scratch_path(spark, "catalog")
    # a row is a file to write: dealt to all tasks, as a few row groups hold very many
    cv = V.catalog_v(spark, d).repartition(shuffle_partitions(spark), "payload_id")
    pid = F.col("payload_id")
    write_tree(cv.select(F.col("provider").alias("project"),
                         F.concat(F.floor(pid / 1000).cast("string"), F.lit("/"), pid.cast("string"), F.lit(".json")).alias("relative"),
                         F.col("payload").alias("text")), root)
    folders = spark.createDataFrame([(p, f"{root}/{p}") for p in ("gemini", "ollama", "generic")], "provider string, folder string")
    return G.normalize_catalog(G.read_catalogs(folders)).select("provider", "id", "name", "context", "active")


def b1_prune_dirs(spark, d):
    return C.prune_dirs(files(spark, d)).select("project", "relative")


def b2_text_names(spark, d):
    return C.keep_text_names(files(spark, d)).select("project", "relative", "name", "ext")


def b3_binary_sniff(spark, d):
    """Bytes of every document; in two of five a NUL inside the sniffed
    bytes (first and last of them), in one the byte after."""
    from revlens.sources.corpus_tree import is_binary
    text = F.coalesce(F.col("text"), F.lit(""))
    front = (F.when(F.col("doc_id") % 5 == 0, F.lit("\0")).when(F.col("doc_id") % 5 == 1, F.concat(F.repeat(F.lit("a"), 8191), F.lit("\0")))
             .when(F.col("doc_id") % 5 == 2, F.concat(F.repeat(F.lit("a"), 8192), F.lit("\0"))).otherwise(F.lit("")))
    docs = V.read_table(spark, d, "documents").select("doc_id", F.encode(F.concat(front, text), "UTF-8").alias("content"))
    return docs.select("doc_id", F.octet_length("content").cast("bigint").alias("size"), is_binary(F.col("content")).alias("is_binary"))


def b4_decode_text(spark, d):
    """Bytes of every document: UTF-8, UTF-8 behind a byte-order mark, and
    ASCII behind bytes that only cp1252 or only latin-1 can read."""
    from revlens.sources.corpus_tree import decode_text
    text, m = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id") % 5
    front = (F.when(m == 1, F.lit("EFBBBF")).when(m == 2, F.lit("E9")).when(m == 3, F.lit("8093")).when(m == 4, F.lit("8180"))
             .otherwise(F.lit("")))
    body = F.when(m >= 2, F.regexp_replace(text, r"[^\x00-\x7F]", "?")).otherwise(text)
    docs = V.read_table(spark, d, "documents").select("doc_id", F.concat(F.unhex(front), F.encode(body, "UTF-8")).alias("content"))
    return docs.select("doc_id", decode_text(F.col("content")).alias("decoded")).select(
        "doc_id", F.length("decoded").cast("bigint").alias("chars"), F.sha2("decoded", 256).alias("text_sha"))


def b5_file_loc(spark, d):
    return files(spark, d).select("project", "relative", F.col("lines").alias("loc"))


def b6_part_loc(spark, d):
    docs = V.read_table(spark, d, "documents")
    return docs.select("doc_id", X.part_loc("text").alias("part_loc"))


def b7_token_estimate(spark, d):
    return files(spark, d).select("project", "relative", "tokens")


def b8_size(spark, d):
    return files(spark, d).select("project", "relative", "size", X.human_size(F.col("size")).alias("size_h"))


def b9_safe_name(spark, d):
    return files(spark, d).select("project", "relative",
                                  X.safe_name(F.concat_ws("-", "project", "relative")).alias("safe"))


def b10_file_order(spark, d):
    return C.with_file_order(reviewable(spark, d)).select("project", "relative", "file_order")


def c1_project_totals(spark, d):
    return C.project_totals(reviewable(spark, d))


def c2_file_table(spark, d):
    return C.file_table(reviewable(spark, d))


def c3_language_breakdown(spark, d):
    return C.language_breakdown(reviewable(spark, d))


def c4_context_fit(spark, d):
    return C.context_fit(C.project_totals(reviewable(spark, d)))


def c5_codebase_signature(spark, d):
    return C.codebase_signature(reviewable(spark, d))


def c6_chunk_signature(spark, d):
    return D.chunk_headers(members(spark, d))


# ---------------------------------------------------------------- D
def d1_hard_split(spark, d):
    docs = V.read_table(spark, d, "documents").select("doc_id", "text")
    parts = D.hard_split(docs, F.lit(SPLIT_WIDTH))
    return parts.select("doc_id", "part_no", "part_count", F.length("part_text").cast("bigint").alias("chars"),
                        F.sha2("part_text", 256).alias("part_sha"))


TOKEN_SPLIT = 400


def d2_split_by_tokens(spark, d):
    """Hard split of every document with a supplied encoder (whitespace
    tokens: a run of non-space characters with its leading spaces)."""
    from revlens.operators.scoring import WhitespaceEncoder, split_by_tokens
    docs = V.read_table(spark, d, "documents").select("doc_id", "text")
    parts = split_by_tokens(docs, WhitespaceEncoder(), TOKEN_SPLIT)
    return parts.select("doc_id", "part_no", "part_count", F.col("part_tokens").cast("bigint").alias("part_tokens"),
                        F.sha2("part_text", 256).alias("part_sha"))


def d3_pack_chunks(spark, d):
    return members(spark, d).drop("chars")


def d4_part_meta(spark, d):
    rv = reviewable(spark, d).where(F.col("tokens") > BUDGET)
    parts = D.part_rows(D.hard_split(rv, D.split_width(BUDGET)))
    return parts.select("project", F.col("part_relative").alias("relative"), "part_no", "part_count",
                        F.col("part_size").alias("size"), F.col("part_lines").alias("lines"),
                        F.col("part_tokens").alias("tokens"))


def packed(files: DataFrame) -> DataFrame:
    """The chunk members (numbers), written once: they are read several times."""
    from revlens.plans.session import materialized
    return materialized(D.pack_chunks(files, BUDGET), "members")


def d5_retry_split(spark, d):
    rv = reviewable(spark, d)
    return D.retry_split(packed(rv), D.member_texts(rv, BUDGET))


def prompts(spark, d) -> DataFrame:
    from revlens.operators.prompts import render_prompts
    rv = reviewable(spark, d)
    return render_prompts(packed(rv), rv, BUDGET)


def d6_prompts(spark, d):
    return prompts(spark, d).select("project", "chunk_id", "n_files", "tokens", "signature", F.length("prompt").cast("bigint").alias("prompt_chars"),
                                    F.sha2("prompt", 256).alias("prompt_sha"))


def d7_context_budget(spark, d):
    from revlens.operators import catalog as G
    m = G.normalize_catalog(V.catalog_v(spark, d))
    return m.select("provider", "id", "context",
                    D.context_budget(F.coalesce(F.col("context"), F.lit(8192))).alias("budget"))


def peak_tpm(spark, d) -> DataFrame:
    a = V.attempts_v(spark, d)
    per_min = a.groupBy("provider", F.date_trunc("minute", F.col("ts")).alias("minute")).agg(
        F.sum("tokens").alias("tok"))
    return per_min.groupBy("provider").agg(F.max("tok").cast("bigint").alias("tpm"))


def d8_rate_policy(spark, d):
    pol = D.rate_policy(peak_tpm(spark, d).withColumn("context", F.lit(CONTEXT)))
    return pol.select("provider", "tpm", "policy_source", "budget", F.round("delay", 6).alias("delay"))


def model_policies(spark, d) -> DataFrame:
    """Budget and delay of each known model: every second one under the peak
    rate of a provider of the attempt log, the others by context only."""
    known = spark.range(1).select(F.posexplode(D.known_models()).alias("i", "m")).select("i", "m.*")
    of = F.when(F.col("i") % 2 == 0, F.concat(F.lit("prov"), (F.col("i") % 4).cast("string")))
    peak = peak_tpm(spark, d).select(F.col("provider").alias("of"), "tpm")
    return D.rate_policy(known.withColumn("of", of).join(peak, "of", "left"))


def d9_chunk_plan(spark, d):
    rv = reviewable(spark, d)
    return D.chunk_plan(rv, C.project_totals(rv), model_policies(spark, d))


# ---------------------------------------------------------------- E
def length_reviewer(prompts):
    """A deterministic stand-in model for the scoring hook: reports the
    prompt size (used to test E0 end to end)."""
    import json
    return [(json.dumps({"summary": f"chars {len(p)}"}), {"prompt_tokens": max(1, round(len(p) / 3.5))})
            for p in prompts]


def e0_score_chunks(spark, d):
    from revlens.operators.scoring import score_chunks
    out = score_chunks(prompts(spark, d), length_reviewer)
    return out.select("project", "chunk_id", "raw", F.col("usage")["prompt_tokens"].alias("usage_prompt"), "error")


def e1_rule_findings(spark, d):
    return E.rule_findings(reviewable(spark, d)).select(
        "project", "file", "line", "rule", "category", "severity", "title",
        F.sha2("evidence", 256).alias("evidence_sha"))


def e2_strip_fences(spark, d):
    r = V.responses_v(spark, d)
    return r.select("project", "chunk_id", X.strip_fences(F.col("raw")).alias("cleaned"))


def e3_parse_json(spark, d):
    p = parsed(spark, d)
    return p.select("project", "chunk_id", F.col("v").isNotNull().alias("parsed"),
                    F.try_variant_get("v", "$.summary", "string").alias("summary"))


def odd_replies(spark, d) -> DataFrame:
    """The replies, most of them spoilt in a way in which parsers differ."""
    r = V.responses_v(spark, d)
    m, raw = F.col("chunk_id") % 13, F.col("raw")
    return r.withColumn("raw", F.when(m == 1, F.concat(raw, F.lit(" {}"))).when(m == 2, F.concat(raw, F.lit("] }")))
                        .when(m == 3, F.replace(raw, F.lit('"confidence":"Low"'), F.lit('"confidence":NaN')))
                        .when(m == 4, F.replace(raw, F.lit('{"summary":'), F.lit('{"summary":"first","summary":')))
                        .when(m == 5, F.concat(raw, F.lit(", {}"))).when(m == 6, F.replace(raw, F.lit('"findings":'), F.lit('"findings" ')))
                        .when(m == 7, F.concat(F.lit("[] "), raw)).when(m == 8, F.concat(raw, F.lit(" and } so on"))).otherwise(raw))


def e3_parse_strict(spark, d):
    """Python's acceptance, over odd replies."""
    p = E.parse_replies(odd_replies(spark, d), strict=True)
    return p.select("project", "chunk_id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.summary", "string").alias("summary"),
                    F.try_variant_get("v", "$.findings[0].confidence", "string").alias("confidence"))


def e4_reply_errors(spark, d):
    p = parsed(spark, d)
    return p.where(~F.col("ok")).select("project", "chunk_id", "error")


def e5_findings(spark, d):
    return E.explode_findings(parsed(spark, d)).select(*FINDING_OUT)


def e6_summaries(spark, d):
    return E.summaries(parsed(spark, d)).select("project", "chunk_id", "summary", "summary_rank")


def e7_usage_totals(spark, d):
    return E.usage_totals(parsed(spark, d), usage_map())


def e8_point_lists(spark, d):
    p = parsed(spark, d)
    a = E.point_list(p, "positive_points").withColumn("field", F.lit("positive_points"))
    b = E.point_list(p, "recommendations").withColumn("field", F.lit("recommendations"))
    return a.unionByName(b).select("project", "field", "item", "item_rank")


def e9_failed_chunks(spark, d):
    from revlens.operators import attempts as A
    m = packed(current_docs(spark, d))
    led = A.failed_chunks(A.replay_attempts(V.chunk_attempts_v(spark, d)), D.chunk_headers(m), m)
    return led.select("project", "chunk_id", "signature", F.array_join("files", "|").alias("files"), "tokens", "attempts", "error")


def e9_bad_replies(spark, d):
    """The failed chunks of the replies alone (no attempt log)."""
    return E.failed_ledger(parsed(spark, d)).groupBy("project").agg(
        F.count(F.lit(1)).alias("n_failed"),
        F.min("chunk_id").alias("first_failed"), F.max("chunk_id").alias("last_failed"))


def e10_dedup(spark, d):
    return unique_findings(spark, d).select("project", "dedup_key", *FINDING_OUT[1:])


def e11_rank(spark, d):
    r = E.rank_findings(unique_keys(spark, d))
    return r.select("project", "finding_rank", "severity_rank", "k_file", "line_num", "chunk_id", "pos")


def e12_status(spark, d):
    p = parsed(spark, d)
    u = E.dedup_findings(E.explode_findings(p))
    return E.overall_status(p, u, p.where(~F.col("ok")))


def e13_severity_counts(spark, d):
    return E.severity_counts(unique_keys(spark, d))


def review_record(spark, d, p: DataFrame) -> DataFrame:
    return E.review_records(p, usage_map(), PROVIDER, MODEL, CONTEXT, C.project_totals(current_docs(spark, d), folder=True), when=WHEN)


def e14_review_record(spark, d):
    rec = review_record(spark, d, parsed(spark, d))
    return rec.select(*[c for c in rec.columns if c != "usage"],
                      F.col("usage")["prompt_tokens"].alias("usage_prompt"),
                      F.col("usage")["completion_tokens"].alias("usage_completion"))


def e15_line_label(spark, d):
    u = E.with_line_label(unique_keys(spark, d))
    return u.select("project", "chunk_id", "pos", "line_label")


def e16_finding_html(spark, d):
    b = E.finding_blocks(E.rank_findings(unique_findings(spark, d)))
    return b.select("project", "finding_rank", F.sha2("html", 256).alias("html_sha"),
                    F.length("html").cast("bigint").alias("html_chars"))


def review_tables(spark, d):
    """(parsed replies, review records, ranked findings), the hub of them written once."""
    from revlens.plans.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    p = parsed(spark, d).drop("raw", "cleaned").checkpoint(eager=True)
    return p, review_record(spark, d, p), E.rank_findings(E.dedup_findings(E.explode_findings(p)))


def a6_write_review(spark, d):
    """Review records and ranked findings written and read back: one row a
    finding with the status of its project."""
    from revlens.plans.session import scratch_path
    from revlens.sources.io import write_review
    path = scratch_path(spark, "review")
    _, rec, ranked = review_tables(spark, d)
    write_review(rec, ranked, path)
    reviews, findings = (spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/{t}") for t in ("reviews", "findings"))
    status = reviews.select(F.col("project").cast("string").alias("project"), "overall_status", "n_findings")
    found = findings.select(F.col("project").cast("string").alias("project"), "finding_rank", "dedup_key", "chunk_id", "pos")
    return status.join(found, "project", "left")


def report(spark, d) -> tuple[DataFrame, DataFrame]:
    """(page rows, review records)."""
    p, rec, ranked = review_tables(spark, d)
    return E.report_rows(rec, E.finding_blocks(ranked), E.summaries(p), E.point_list(p, "positive_points"),
                         E.point_list(p, "recommendations")), rec


def a7_write_reports(spark, d):
    """The report pages written, one file a project, and read back whole."""
    from revlens.plans.session import scratch_path
    from revlens.sources.io import write_reports
    path = scratch_path(spark, "reports")
    rows, rec = report(spark, d)
    write_reports(rows, rec, path, when=WHEN)
    pages = spark.read.text(f"{path}/*.html", wholetext=True).select("value", F.col("_metadata.file_name").alias("report"))
    return pages.select("report", F.sha2("value", 256).alias("page_sha"), F.length("value").cast("bigint").alias("page_chars"))


def e16_report_rows(spark, d):
    """Every row of every page."""
    return report(spark, d)[0].select("project", "section", "seq", F.sha2("html", 256).alias("html_sha"))


# ---------------------------------------------------------------- F
def docs_corpus(df: DataFrame) -> DataFrame:
    """Documents as a corpus: project = source, relative = doc/<id>.txt."""
    return C.corpus_from_table(df.select(F.col("project"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"),
                                                                    F.lit(".txt")).alias("relative"), "text"))


def current_docs(spark, d):
    docs = V.read_table(spark, d, "documents").select(F.col("source").alias("project"), "doc_id", "text")
    return docs_corpus(docs)


def snapshot_docs(spark, d):
    return docs_corpus(V.snapshot_v(spark, d))


def f1_valid_checkpoints(spark, d):
    from revlens.operators import attempts as A
    cur = C.codebase_signature(current_docs(spark, d)).select("project", "signature")
    states = C.codebase_signature(snapshot_docs(spark, d)).select("project", "signature")
    ctx = dict(provider=F.lit(PROVIDER), model=F.lit(MODEL))
    cur, states = cur.withColumns(ctx), states.withColumns(ctx)
    ok = A.valid_checkpoints(states, cur).withColumn("valid", F.lit(True))
    return (states.join(ok, ["project", "provider", "model", "signature"], "left")
            .select("project", "provider", "model", F.coalesce("valid", F.lit(False)).alias("valid")))


def pending(spark, d) -> DataFrame:
    from revlens.operators import attempts as A
    cur = D.chunk_headers(D.pack_chunks(current_docs(spark, d), BUDGET))
    done = D.chunk_headers(D.pack_chunks(snapshot_docs(spark, d), BUDGET))
    return A.pending_chunks(cur, done)


def f2_pending_chunks(spark, d):
    return pending(spark, d).select("project", "chunk_id", "n_files", "tokens", "signature")


def failures_successes(spark, d):
    a = V.attempts_v(spark, d)
    ok = F.col("status").isNotNull() & (F.col("status") >= 200) & (F.col("status") < 300)
    return a.where(~ok | F.col("status").isNull()), a.where(ok)


def f3_latest_failures(spark, d):
    from revlens.operators import attempts as A
    fail, succ = failures_successes(spark, d)
    r = A.latest_failures(fail, succ)
    return r.select("provider", "chunk_id", "attempt", "event_id", "status", "detail")


def f4_retryable(spark, d):
    from revlens.operators import attempts as A
    a = V.attempts_v(spark, d)
    return a.select("event_id", A.retryable(F.col("status"), F.col("detail")).alias("retryable"))


def f5_context_error(spark, d):
    from revlens.operators import attempts as A
    a = V.attempts_v(spark, d)
    return a.select("event_id", A.context_error(F.col("status"), F.col("detail")).alias("context_error"),
                    A.status_hint(F.col("status")).alias("hint"))


def f6_next_wait(spark, d):
    from revlens.operators import attempts as A
    p = A.plan_attempts(V.attempts_v(spark, d), with_jitter=False)
    return p.select("event_id", "action", "wait_sec")


def f7_pacing_plan(spark, d):
    from revlens.operators import attempts as A
    q = A.pacing_plan(pending(spark, d), DELAY)
    return q.select("project", "chunk_id", "queue_pos", "start_offset_sec", "projected_finish_sec")


def f8_requeue(spark, d):
    from revlens.operators import attempts as A
    cur = current_docs(spark, d)
    mem = packed(cur)
    heads = D.chunk_headers(mem)
    done = D.chunk_headers(D.pack_chunks(snapshot_docs(spark, d), BUDGET))
    pend = A.pending_chunks(heads, done)
    split = D.retry_split(mem.join(pend.select("project", "chunk_id"), ["project", "chunk_id"], "left_semi"), D.member_texts(cur, BUDGET))
    return A.requeue(split, pend).select("project", "chunk_id", "sub_id", "priority", "queue_pos")


def f8_keep_state(spark, d):
    """Resume states (per project signature of the corpus) kept only for
    projects whose replies still hold failed chunks."""
    from revlens.operators import attempts as A
    states = C.codebase_signature(current_docs(spark, d)).select("project", "signature")
    failed = parsed(spark, d).where(~F.col("ok")).select("project", "chunk_id")
    return A.keep_state(states, failed).select("project", "signature")


# ---------------------------------------------------------------- G
def models(spark, d):
    from revlens.operators import catalog as G
    return G.normalize_catalog(V.catalog_v(spark, d))


def g1_normalize_catalog(spark, d):
    return models(spark, d)


def g2_provider_shapes(spark, d):
    m = models(spark, d)
    return m.groupBy("provider").agg(F.count(F.lit(1)).alias("models"),
                                     F.count("context").alias("with_context"),
                                     F.sum(F.col("id").startswith("models/").cast("int")).cast("bigint").alias("prefixed"))


def ranked_models(spark, d):
    from revlens.operators import catalog as G
    return G.rank_models(models(spark, d))


def g3_rank_models(spark, d):
    return ranked_models(spark, d).select("provider", "payload_id", "pos", "id", "penalty", "model_rank")


SEARCH_TEXT = "red"


def g4_search_models(spark, d):
    from revlens.operators import catalog as G
    return G.search_models(ranked_models(spark, d), SEARCH_TEXT).select("provider", "id", "model_rank", "match_rank")


def g5_model_page(spark, d):
    from revlens.operators import catalog as G
    return G.model_page(ranked_models(spark, d), 1).select("provider", "id", "model_rank")


def g6_context_lookup(spark, d):
    from revlens.operators import catalog as G
    r = G.context_lookup(models(spark, d).withColumnRenamed("id", "model"), "model", live="context")
    return r.select("provider", "payload_id", "pos", "model", "context_assumed", "context_source")


def g7_in_active_list(spark, d):
    from revlens.operators import catalog as G
    req = V.read_table(spark, d, "part").select(F.lit("generic").alias("provider"), "p_partkey",
                                                F.col("p_name").alias("model"))
    r = G.in_active_list(req, models(spark, d))
    return r.select("p_partkey", "model", "active", "live_context")


# ---------------------------------------------------------------- H
def h1_sanitize(spark, d):
    from revlens.operators import hygiene as H
    return V.secrets_v(spark, d).select("doc_id", "owner", H.sanitize(F.col("value")).alias("key"))


def h2_mask(spark, d):
    from revlens.operators import hygiene as H
    return V.secrets_v(spark, d).select("doc_id", H.mask(H.sanitize(F.col("value"))).alias("masked"))


def h3_fingerprint(spark, d):
    from revlens.operators import hygiene as H
    k = H.sanitize(F.col("value"))
    return V.secrets_v(spark, d).select("doc_id", H.fingerprint(k).alias("fingerprint"),
                                        F.length(k).cast("bigint").alias("length"))


def h4_format_check(spark, d):
    from revlens.operators import hygiene as H
    s = V.secrets_v(spark, d).select("doc_id", F.lit("groq").alias("provider"),
                                     H.sanitize(F.col("value")).alias("key"))
    r = H.format_check(s, "provider", "key")
    return r.select("doc_id", "valid", "prefix_ok", F.array_join("messages", " | ").alias("messages"))


def h5_key_status(spark, d):
    from revlens.operators import hygiene as H
    owners = V.read_table(spark, d, "documents").select(F.col("source").alias("owner")).distinct()
    r = H.key_status(owners, V.secrets_v(spark, d))
    return r.select("owner", "status", "fingerprint", "length")


def h6_scan_secrets(spark, d):
    from revlens.operators import hygiene as H
    return H.scan_secrets(V.read_table(spark, d, "documents"))


# ---------------------------------------------------------------- J
def j1_changed_files(spark, d):
    from revlens.operators import history as J
    return J.changed_files(current_docs(spark, d), snapshot_docs(spark, d))


def j1_changed_only(spark, d):
    """The chunks of the corpus now, packed again only around changed files."""
    from revlens.operators import history as J
    from revlens.operators.packing import narrow_files, place_files
    from revlens.operators.repack import repack
    cur, old = current_docs(spark, d), snapshot_docs(spark, d)
    placed = place_files(narrow_files(old), BUDGET, max(1000, 3 * BUDGET))
    new = repack(cur, J.changed_files(cur, old), placed, D.chunk_headers(D.pack_chunks(old, BUDGET)), BUDGET)
    return new.chunks.select("project", "chunk_id", "n_files", "tokens", "signature")


def rule_runs(spark, d):
    """The rules on the corpus now and then; each finding as a range of up to
    three lines, and of the earlier run moved by up to four."""
    run = lambda files, by: E.rule_findings(files).withColumns({
        "line_end": F.col("line") + by + F.col("line") % 3, "line": F.col("line") + by})
    now, then = current_docs(spark, d), snapshot_docs(spark, d)
    return run(now, F.lit(0)), run(then, F.length("file") % 5)


def j2_finding_history(spark, d):
    from revlens.operators import history as J
    now, then = rule_runs(spark, d)
    return J.finding_history(now, then)


def rule_counts(spark, d):
    f = E.rule_findings(reviewable(spark, d))
    k = f.select("project", "severity", F.sha2(F.concat_ws("|", "category", "severity", "file",
                                                          F.col("line").cast("string"), "title"), 256).alias("k"))
    u = k.distinct()
    return u.groupBy("project").agg(*[F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).cast("bigint")
                                      .alias(s.lower()) for s in ("Critical", "High", "Medium", "Low", "Info")])


def j3_quality_gate(spark, d):
    from revlens.operators import history as J
    return J.quality_gate(rule_counts(spark, d))


def j4_risk_score(spark, d):
    from revlens.operators import history as J
    return J.risk_score(rule_counts(spark, d), C.project_totals(reviewable(spark, d)))


def j5_model_agreement(spark, d):
    """Three reviewers: the rules now, on the earlier files (moved), and now
    without line ranges."""
    from revlens.operators import history as J
    now, then = rule_runs(spark, d)
    cols = ["project", "file", "category", "line", "line_end", "model"]
    runs = [now.withColumn("model", F.lit("now")), then.withColumn("model", F.lit("then")),
            now.where(F.col("line") % 2 == 0).withColumns({"model": F.lit("points"), "line_end": F.lit(None).cast("bigint")})]
    return J.model_agreement(runs[0].select(*cols).unionByName(runs[1].select(*cols)).unionByName(runs[2].select(*cols)))


def j6_billed_tokens(spark, d):
    from revlens.operators import attempts as A
    from revlens.operators import history as J
    cur = D.chunk_headers(D.pack_chunks(current_docs(spark, d), BUDGET))
    return J.billed_tokens(cur, A.replay_attempts(V.chunk_attempts_v(spark, d)))


def f6_replay(spark, d):
    """The attempt log replayed by chunk: calls, attempts and what each led to."""
    from revlens.operators import attempts as A
    return A.replay_attempts(V.chunk_attempts_v(spark, d)).select("event_id", "project", "chunk_id", "call_no", "attempt_no", "action", "spare")


QUERIES: dict[str, Query] = {name: fn for name, fn in dict(globals()).items()
                             if callable(fn) and name[:1] in "abcdefghj" and name[1:2].isdigit()}


def _streams() -> dict[str, Query]:
    from revlens.streaming.streams import STREAM_QUERIES
    return dict(STREAM_QUERIES)


QUERIES.update(_streams())
