"""Planned features named in the README, built on the same tables:
changed files between snapshots, finding history, quality gate, risk score,
multi-model agreement and a billed-token estimate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators import ranges as R
from revlens.plans.session import materialized

# --- Our parameters (the README names these features without numbers) ------
GATE_MAX = {"Critical": 0, "High": 0, "Medium": 25}           # quality gate
RISK_WEIGHTS = {"Critical": 10, "High": 5, "Medium": 2, "Low": 1, "Info": 0}


def changed_files(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """Full outer join on (project, relative) comparing content sha:
    added / removed / changed / unchanged.  Only changed and added files need
    a new review (changed-files-only mode)."""
    c = current.select("project", "relative", F.sha2("text", 256).alias("sha_now"), F.col("tokens").alias("tok_now"))
    e = earlier.select("project", "relative", F.sha2("text", 256).alias("sha_then"))
    j = c.join(e, ["project", "relative"], "full_outer")
    status = (F.when(F.col("sha_then").isNull(), "added").when(F.col("sha_now").isNull(), "removed")
              .when(F.col("sha_now") != F.col("sha_then"), "changed").otherwise("unchanged"))
    return j.select("project", "relative", status.alias("change"), F.col("tok_now").alias("tokens"))


def finding_key(df: DataFrame) -> DataFrame:
    """Dedup key of a finding table with category / severity / file / line /
    title columns (same text rule as E10)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("category", "severity", "file", "line", "title")]
    return df.withColumn("finding_key", F.sha2(F.concat_ws("|", *parts), 256))


#: Lines that a finding may have moved by and still be the same one.
MOVED_LINES = 2
_PLACE = ("project", "file", "category", "title")


def _ranges(findings: DataFrame) -> DataFrame:
    """Distinct findings as line ranges; one without a line is line 0."""
    lo = F.coalesce("line", F.lit(0)).cast("bigint")
    return findings.select(*_PLACE, "severity", lo.alias("lo"), F.greatest(lo, F.coalesce("line_end", F.lit(0)).cast("bigint")).alias("hi")).distinct()


def finding_history(current: DataFrame, earlier: DataFrame, moved: int = MOVED_LINES) -> DataFrame:
    """New / fixed / persisting findings.  A finding persists if the other
    run has one of its file, category and title whose lines meet its own,
    ``moved`` lines allowed; so an edit above it or a wider range leave it the
    same.  Columns: project, file, category, title, lo, hi, severity, state."""
    # each side is read by every join below: the runs behind them go once
    now, then = materialized(_ranges(current), "findings-now"), materialized(_ranges(earlier), "findings-then")
    keys = [*_PLACE]

    def judged(rows: DataFrame, others: DataFrame, alone: str, side: str) -> DataFrame:
        met = R.overlapping(rows, others, keys, ("lo", "hi"), ("lo", "hi"), moved).withColumn("_met", F.lit(True))
        met = met.select(*[F.col(c).alias(f"_m_{c}") for c in [*keys, "lo", "hi"]], "_met")
        on = F.lit(True)
        for c in [*keys, "lo", "hi"]:
            on = on & F.col(c).eqNullSafe(F.col(f"_m_{c}"))
        out = rows.join(met, on, "left").select(*rows.columns, F.when(F.col("_met"), "persisting").otherwise(alone).alias("state"))
        return out if side == "now" else out.where(F.col("state") == alone)

    return judged(now, then, "new", "now").unionByName(judged(then, now, "fixed", "then"))


def quality_gate(counts: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Pass when each gated severity count is at most its limit."""
    limits = limits or GATE_MAX
    ok = F.lit(True)
    for sev, lim in limits.items():
        ok = ok & (F.col(sev.lower()) <= lim)
    failing = F.concat_ws(",", *[F.when(F.col(s.lower()) > lim, F.lit(s)) for s, lim in limits.items()])
    return counts.select("project", *[s.lower() for s in K.SEVERITIES], ok.alias("gate_pass"),
                         failing.alias("failing"))


def risk_score(counts: DataFrame, totals: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Weighted findings per 1,000 LOC."""
    weights = weights or RISK_WEIGHTS
    w = sum(F.col(s.lower()) * F.lit(v) for s, v in weights.items())
    j = totals.select("project", "loc").join(counts, "project", "left").na.fill(0)
    return j.select("project", "loc", w.cast("bigint").alias("weighted"),
                    F.round(F.when(F.col("loc") > 0, w * 1000.0 / F.col("loc")), 6).alias("risk_per_kloc"))


def model_agreement(findings: DataFrame, moved: int = 0) -> DataFrame:
    """How many distinct models report the same place of a file: chains of
    meeting line ranges of one category.  Columns: project, file, category,
    lo, hi (of the chain), models, reports."""
    lo = F.coalesce("line", F.lit(0)).cast("bigint")
    rows = findings.select("project", "file", "category", "model", lo.alias("lo"),
                           F.greatest(lo, F.coalesce("line_end", F.lit(0)).cast("bigint")).alias("hi"))
    chains = R.range_groups(rows, ["project", "file", "category"], "lo", "hi", moved)
    return chains.groupBy("project", "file", "category", "range_group").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_distinct("model").alias("models"), F.count("*").alias("reports")).drop("range_group")


def billed_tokens(chunks: DataFrame, replayed: DataFrame) -> DataFrame:
    """Billed input tokens per project from the replayed attempt log
    (``attempts.replay_attempts``).  A request carries the chunk's code tokens
    and the overhead (1,500); it is billed when the model answered or the
    connection broke (no status), not when it was refused with an error.
    ``planned`` is the estimate before any attempt: one request a chunk."""
    per = chunks.groupBy("project").agg(F.count("*").alias("chunks"), F.sum("tokens").cast("bigint").alias("code_tokens"))
    sent = replayed.join(chunks.select("project", "chunk_id", "tokens"), ["project", "chunk_id"])
    cost = F.col("tokens") + K.REQUEST_OVERHEAD
    reached = F.col("status").isNull() | ((F.col("status") >= 200) & (F.col("status") < 300))
    n = lambda cond: F.sum(cond.cast("int")).cast("bigint")
    used = sent.groupBy("project").agg(
        F.count("*").alias("requests"), n(F.col("action") == "retry").alias("retries"), n(F.col("action") == "split").alias("splits"),
        n(F.col("action") == "fail").alias("failures"), n((F.col("action") == "done") & ~F.col("spare")).alias("done"),
        F.sum(F.when(reached, cost)).cast("bigint").alias("billed"),
        F.sum(F.when(reached & ((F.col("action") != "done") | F.col("spare")), cost)).cast("bigint").alias("wasted"))
    j = per.join(used.select(F.col("project").alias("_of"), *used.columns[1:]), F.col("project").eqNullSafe(F.col("_of")), "left").drop("_of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return j.select("project", "chunks", "code_tokens", (F.col("code_tokens") + F.col("chunks") * K.REQUEST_OVERHEAD).cast("bigint").alias("planned"),
                    *[zero(c) for c in ("requests", "retries", "splits", "failures", "done", "billed", "wasted")])
