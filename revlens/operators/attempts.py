"""Resume and attempt planning over tables of attempts (no live calls).

The intended retry rules are built on an attempt log with a real ``status``
column (the original never raises its HTTP error type, so its context-error
split and Retry-After paths are dead code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.plans.prefix import ordinal, running_sums


def valid_checkpoints(states: DataFrame, current: DataFrame,
                      keys=("project", "provider", "model", "signature")) -> DataFrame:
    """a saved state is valid only when project, provider, model and
    codebase signature all equal the current run's (inner join)."""
    return states.join(current.select(*keys).distinct(), list(keys), "left_semi")


def pending_chunks(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """chunks whose signature is not completed (anti-join).  Run it
    before any costly scoring: Catalyst cannot push an anti-join through a
    Python batch function."""
    return chunks.join(completed.select("project", "signature").distinct(), ["project", "signature"], "left_anti")


def latest_failures(failures: DataFrame, successes: DataFrame, key=("provider", "chunk_id"),
                    order=("ts", "event_id")) -> DataFrame:
    """the failure record of a chunk is cleared by a later success; per
    chunk keep the latest failure when it is newer than the last success.
    Both "latest" values are maxima over structs led by the order columns:
    aggregations, combined map-side even for a hot chunk."""
    rest = [c for c in failures.columns if c not in key and c not in order]
    latest = failures.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    last_ok = successes.groupBy(*key).agg(F.max(F.struct(*order)).alias("ok"))
    j = latest.join(last_ok, list(key), "left")
    newer = F.col("ok").isNull() | (F.struct(*[F.col(f"r.{o}") for o in order]) > F.col("ok"))
    return j.where(newer).select(*key, "r.*")


def retryable(status: Column, detail: Column) -> Column:
    """status in the retryable set; with no status, a word of the
    message (case-insensitive)."""
    words = F.lit(False)
    low = F.lower(F.coalesce(detail, F.lit("")))
    for w in K.RETRYABLE_WORDS:
        words = words | low.contains(w)
    return F.when(status.isNotNull(), status.isin(*K.RETRYABLE_STATUSES)).otherwise(words)


def context_error(status: Column, detail: Column) -> Column:
    """status 400 / 413 and one of the context phrases."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    hit = F.lit(False)
    for m in K.CONTEXT_ERROR_MARKERS:
        hit = hit | low.contains(m)
    return F.coalesce(status.isin(*K.CONTEXT_ERROR_STATUSES) & hit, F.lit(False))


def status_hint(status: Column) -> Column:
    m = F.create_map(*[x for s, h in K.STATUS_HINTS.items() for x in (F.lit(s), F.lit(h))])
    return F.coalesce(F.element_at(m, status.cast("int")), F.lit(""))


def jitter(*keys: Column) -> Column:
    """Deterministic jitter in [0, 0.75): a hash of the attempt's keys, so a
    re-run plans the same waits."""
    h = F.pmod(F.xxhash64(*keys), F.lit(1 << 20)).cast("double") / float(1 << 20)
    return h * K.JITTER_MAX


def plan_attempts(attempts: DataFrame, with_jitter: bool = True) -> DataFrame:
    """Per attempt row: retryable, context_error, hint, the wait
    before the next attempt and the action (done / split / retry / fail).
    Retry-After (when given with a status) is clamped to 0.5..120; else
    min(120, 2^(attempt-1) + jitter); at most 5 attempts."""
    st, det, att = F.col("status"), F.col("detail"), F.col("attempt")
    ra = F.col("retry_after")
    backoff = F.least(F.lit(K.BACKOFF_MAX), F.pow(F.lit(2.0), att - 1) +
                      (jitter(F.col("provider"), F.col("chunk_id"), att) if with_jitter else F.lit(0.0)))
    wait = F.when(st.isNotNull() & ra.isNotNull(),
                  F.greatest(F.lit(K.RETRY_AFTER_MIN), F.least(F.lit(K.RETRY_AFTER_MAX), ra))).otherwise(backoff)
    ok = st.isNotNull() & (st >= 200) & (st < 300)
    ctx = context_error(st, det)
    rtry = retryable(st, det)
    action = (F.when(ok, "done").when(ctx, "split").when(rtry & (att < K.MAX_ATTEMPTS), "retry").otherwise("fail"))
    return attempts.select(
        "*", rtry.alias("retryable"), ctx.alias("context_error"), status_hint(st).alias("hint"),
        F.when(action == "retry", F.round(wait, 6)).alias("wait_sec"), action.alias("action"))


def replay_attempts(log: DataFrame, key: tuple[str, ...] = ("project", "chunk_id"), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The attempts of each chunk in order, as calls: a call is a run of
    attempts up to a success (done), a context error (split), a refusal or the
    last attempt allowed (fail).  Adds call_no and attempt_no (both from 1),
    action, and ``spare``: the chunk was done before.

    Calls are islands between the attempts that end one by themselves; inside
    an island every ``MAX_ATTEMPTS``-th attempt ends a call too.  All numbers
    are running sums over slices, so one chunk may hold any share of the log."""
    ok, ctx = (F.col("status") >= 200) & (F.col("status") < 300), context_error(F.col("status"), F.col("detail"))
    ended = F.when(F.coalesce(ok, F.lit(False)), "done").when(ctx, "split").when(~retryable(F.col("status"), F.col("detail")), "fail")
    chunk = F.to_json(F.struct(*key))
    rows = log.withColumns({"_end": ended, "_chunk": chunk})
    at = [F.col(o) for o in order]
    island = running_sums(rows, "_chunk", at, {"_ends": F.col("_end").isNotNull().cast("int"), "_dones": (F.col("_end") == "done").cast("int")})
    island = island.withColumn("_island", F.concat_ws("/", "_chunk", (F.col("_ends") - F.col("_end").isNotNull().cast("int")).cast("string")))
    placed = ordinal(island, "_island", at, "_place")
    attempt = ((F.col("_place") - 1) % K.MAX_ATTEMPTS + 1).cast("int")
    last = F.coalesce(F.col("_end"), F.when(attempt == K.MAX_ATTEMPTS, "fail").otherwise("retry"))
    out = placed.withColumns({"attempt_no": attempt, "action": last,
                              "spare": F.col("_dones") - F.coalesce((F.col("_end") == "done").cast("int"), F.lit(0)) > 0})
    calls = running_sums(out, "_chunk", at, {"_called": (F.col("attempt_no") == 1).cast("int")})
    return calls.select(*log.columns, F.col("_called").alias("call_no"), "attempt_no", "action", "spare")


def failed_chunks(replayed: DataFrame, headers: DataFrame, members: DataFrame) -> DataFrame:
    """E9 from the attempt log: chunks that no attempt has done and whose last
    call failed: signature, files in order, tokens, attempts made and the
    error of the last failure."""
    own = F.struct("ts", "event_id", "action", "status", "detail")
    per = replayed.groupBy("project", "chunk_id").agg(
        F.count("*").alias("attempts"), F.max(F.col("action") == "done").alias("done"),
        F.max(F.when(F.col("action").isin("fail", "split"), own)).alias("last"))
    bad = per.where(~F.col("done") & (F.col("last.action") == "fail"))
    error = F.concat_ws(": ", F.when(F.col("last.status").isNotNull(), F.concat(F.lit("HTTP "), F.col("last.status").cast("string"))),
                        F.when(F.col("last.detail") != "", F.col("last.detail")))
    files = members.groupBy("project", "chunk_id").agg(     # a chunk has at most its budget of members
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "relative"))), lambda m: m["relative"]).alias("files"))
    return (bad.join(headers.select("project", "chunk_id", "signature", "tokens"), ["project", "chunk_id"])
            .join(files, ["project", "chunk_id"])
            .select("project", "chunk_id", "signature", "files", "tokens", "attempts", error.alias("error")))


def pacing_plan(chunks: DataFrame, delay: float, key: str = "project", order: str = "chunk_id") -> DataFrame:
    """start offset of each pending chunk = (n - 1) x delay, n its
    position in the queue (distributed ordinal); finish = last offset."""
    q = ordinal(chunks, key, [F.col(order)], "queue_pos")
    q = q.withColumn("start_offset_sec", F.round((F.col("queue_pos") - 1) * F.lit(float(delay)), 6))
    fin = q.groupBy(key).agg(F.max("start_offset_sec").alias("projected_finish_sec"))
    return q.join(fin, key)


def requeue(split: DataFrame, pending: DataFrame) -> DataFrame:
    """F8: split chunks go ahead of the remaining queue: priority 0 for the
    sub-chunks of a split (in chunk / sub order), 1 for the rest."""
    a = split.select("project", "chunk_id", "sub_id", F.lit(0).alias("priority"))
    done = split.select("project", "chunk_id").distinct()
    b = (pending.join(done, ["project", "chunk_id"], "left_anti")
         .select("project", "chunk_id", F.lit(0).cast("int").alias("sub_id"), F.lit(1).alias("priority")))
    u = a.unionByName(b)
    return ordinal(u, "project", [F.col("priority"), F.col("chunk_id"), F.col("sub_id")], "queue_pos")


def keep_state(states: DataFrame, failed: DataFrame) -> DataFrame:
    """F8: the resume state is kept only for projects with failures left."""
    return states.join(failed.select("project").distinct(), "project", "left_semi")
