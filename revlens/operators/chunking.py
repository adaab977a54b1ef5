"""Chunking: hard splits, ordered budget packing, retry splits, prompts.

``pack_chunks`` (D3) reproduces next-fit packing in corpus order: files up to
the budget fill the current chunk; a larger file flushes it and becomes one
chunk per hard-split part (``packing`` tells how).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.functions import text as X
from revlens.operators.packing import chunk_counts, narrow_files, place_files

# ---------------------------------------------------------------- budgets
def context_budget(context: Column) -> Column:
    """max(1500, min(100000, int(context * 0.5)))."""
    return F.greatest(F.lit(K.MIN_CHUNK_BUDGET),
                      F.least(F.lit(K.MAX_CHUNK_BUDGET),
                              (context.cast("double") * K.CONTEXT_SHARE).cast("bigint"))).cast("bigint")


def rate_policy(df: DataFrame, tpm: str = "tpm", context: str = "context",
                source: str | None = None) -> DataFrame:
    """Per row, the code budget and the pacing delay from tokens/minute.

    No tpm -> the context budget and no delay ("context_only").  A
    ``source`` column equal to 'manual' floors the tpm at 1,000.
    """
    ctx_b = context_budget(F.col(context))
    src = F.col(source) if source else F.lit(None).cast("string")
    t = F.when(src == "manual", F.greatest(F.col(tpm), F.lit(K.MIN_MANUAL_TPM))).otherwise(F.col(tpm))
    rate_b = F.greatest(F.lit(K.MIN_RATE_BUDGET), (t.cast("double") * 0.5).cast("bigint") - K.RATE_OVERHEAD)
    code_b = F.greatest(F.lit(K.MIN_RATE_BUDGET), F.least(ctx_b, rate_b))
    delay = F.least(F.lit(K.MAX_DELAY), F.greatest(
        F.lit(0.0), F.lit(60.0) * (code_b + K.REQUEST_OVERHEAD) / F.greatest(t, F.lit(1)) * K.PACING_SAFETY))
    has = F.col(tpm).isNotNull() & (F.col(tpm) != 0)
    return df.select(
        "*",
        F.when(has, F.coalesce(src, F.lit("live_headers"))).otherwise("context_only").alias("policy_source"),
        F.when(has, t).cast("bigint").alias("policy_tpm"),
        F.when(has, code_b).otherwise(ctx_b).cast("bigint").alias("budget"),
        F.when(has, delay).otherwise(F.lit(0.0)).cast("double").alias("delay"))


# ---------------------------------------------------------------- splits
def split_width(budget: int | Column) -> Column:
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.greatest(F.lit(K.MIN_SPLIT_CHARS), b * K.SPLIT_CHARS_PER_TOKEN)


def hard_split(df: DataFrame, width: Column, text: str = "text") -> DataFrame:
    """Cut text into pieces of ``width`` characters (code points); empty
    text gives no piece.  Adds part_no (1-based), part_count, part_text.
    One pass over the text, whatever the number of pieces."""
    n = F.length(F.col(text))
    pieces = F.regexp_extract_all(F.col(text), F.concat(F.lit("(?s).{1,"), width.cast("string"), F.lit("}")), F.lit(0))
    exploded = df.where(n > 0).select("*", F.ceil(n / width).cast("int").alias("part_count"),
                                      F.posexplode(pieces).alias("_i", "part_text"))
    return (exploded.withColumn("part_no", (F.col("_i") + 1).cast("int")).drop("_i"))


def part_rows(df: DataFrame, label: str = "part") -> DataFrame:
    """Metadata of split parts: label ' [part i/n]', bytes, LOC, tokens."""
    return df.select(
        "*",
        F.format_string(f"%s [{label} %d/%d]", F.col("relative"), F.col("part_no"), F.col("part_count"))
        .alias("part_relative"),
        X.byte_size("part_text").alias("part_size"),
        X.part_loc("part_text").alias("part_lines"),
        X.token_estimate("part_text").alias("part_tokens"),
        F.length("part_text").cast("bigint").alias("part_chars"))


# ---------------------------------------------------------------- packing
def pack_chunks(files: DataFrame, budget: int, num_partitions: int | None = None) -> DataFrame:
    """D3: chunk members (no text): project, chunk_id (1-based), pos (0-based
    in chunk), relative (with ' [part i/n]' for parts), part_no, part_count,
    size, lines, tokens, chars.  One path for projects of every size
    (``packing``); oversized files are split where they are read."""
    B = int(budget)
    width = max(K.MIN_SPLIT_CHARS, K.SPLIT_CHARS_PER_TOKEN * B)
    placed = place_files(narrow_files(files), B, width, num_partitions)
    whole = placed.where(~F.col("over")).select(
        "project", "chunk_id", "pos", "relative", F.lit(None).cast("int").alias("part_no"),
        F.lit(None).cast("int").alias("part_count"), "size", "lines", "tokens", "chars")
    key = F.coalesce(F.concat(F.lit("="), F.col("project")), F.lit(""))
    big = files.where(F.col("tokens") > B).select(key.alias("project"), "relative", "text")
    parts = part_rows(hard_split(big, F.lit(width))).drop("text", "part_text").join(
        placed.where(F.col("over")).select("project", "relative", F.col("chunk_id").alias("first")), ["project", "relative"])
    parts = parts.select(
        "project", (F.col("first") + F.col("part_no") - 1).cast("bigint").alias("chunk_id"),
        F.lit(0).cast("int").alias("pos"), F.col("part_relative").alias("relative"), "part_no", "part_count",
        F.col("part_size").alias("size"), F.col("part_lines").alias("lines"),
        F.col("part_tokens").alias("tokens"), F.col("part_chars").alias("chars"))
    return whole.unionByName(parts).select(
        F.when(F.col("project") != "", F.substring("project", 2, (1 << 31) - 1)).alias("project"), "chunk_id", "pos", "relative", "part_no", "part_count",
        F.col("size").cast("bigint").alias("size"), F.col("lines").cast("bigint").alias("lines"),
        F.col("tokens").cast("bigint").alias("tokens"), F.col("chars").cast("bigint").alias("chars"))


def member_texts(files: DataFrame, budget: int) -> DataFrame:
    """(project, relative, part_no, part_count, lines, tokens, text) of every
    chunk member without a shuffle: whole files up to the budget (part_no
    NULL), and the labelled hard-split parts of the larger ones."""
    none = F.lit(None).cast("int")
    whole = files.where(F.col("tokens") <= budget).select("project", "relative", none.alias("part_no"), none.alias("part_count"), "lines", "tokens", "text")
    big = files.where(F.col("tokens") > budget).select("project", "relative", "text")
    parts = part_rows(hard_split(big, split_width(int(budget))))
    return whole.unionByName(parts.select("project", F.col("part_relative").alias("relative"), "part_no", "part_count",
                                          F.col("part_lines").alias("lines"), F.col("part_tokens").alias("tokens"), F.col("part_text").alias("text")))


def chunk_headers(members: DataFrame) -> DataFrame:
    """Chunk table + C6 signature (``relative:lines:tokens:chars`` in member
    order).  A chunk holds at most ``budget`` members: a bounded group."""
    payload = F.concat_ws(":", "relative", F.col("lines").cast("string"),
                          F.col("tokens").cast("string"), F.col("chars").cast("string"))
    items = F.array_sort(F.collect_list(F.struct(F.col("pos"), payload.alias("p"))))
    return members.groupBy("project", "chunk_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.sha2(F.array_join(F.transform(items, lambda s: s["p"]), "|"), 256).alias("signature"))


# ---------------------------------------------------------------- retry split
def retry_split(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Split a chunk that hit a context limit into smaller chunks.

    total <= 1,500 -> nothing.  Several files -> next-fit over the members
    with target max(1000, total // 2) (a fold over the chunk's members, a
    bounded group).  One file -> hard split of its text with that target;
    fewer than two pieces -> nothing.  Returns (project, chunk_id, sub_id,
    pos, relative, size, lines, tokens).

    ``texts`` are ``member_texts`` of the files.  The pieces of a text depend
    on the text alone, so their numbers are taken where it is read
    (``retry_pieces``) and only numbers meet the chunks: no text moves."""
    stats = members.groupBy("project", "chunk_id").agg(
        F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", "relative", "size", "lines", "tokens"))).alias("seq"))
    stats = stats.where(F.col("total") > K.RETRY_SPLIT_MIN_TOTAL)
    target = F.greatest(F.lit(K.RETRY_SPLIT_MIN_TARGET), F.floor(F.col("total") / 2)).cast("bigint")
    init = F.struct(F.lit(0).cast("bigint").alias("cur"), F.lit(1).alias("g"), F.lit(-1).alias("at"),
                    F.array().cast("array<struct<g:int,at:int>>").alias("ids"))

    def step(acc, x):
        new = (acc["cur"] > 0) & (acc["cur"] + x["tokens"] > F.col("target"))
        g = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        at = F.when(new, F.lit(0)).otherwise(acc["at"] + 1)
        cur = F.when(new, x["tokens"]).otherwise(acc["cur"] + x["tokens"]).cast("bigint")
        return F.struct(cur.alias("cur"), g.alias("g"), at.alias("at"),
                        F.array_append(acc["ids"], F.struct(g.alias("g"), at.alias("at"))).alias("ids"))

    folded = (stats.where(F.col("n") > 1).withColumn("target", target).withColumn("fold", F.aggregate("seq", init, step))
              .where(F.col("fold.g") > 1)
              .select("project", "chunk_id", F.inline(F.arrays_zip(F.col("seq").alias("m"), F.col("fold.ids").alias("to")))))
    multi = folded.select("project", "chunk_id", F.col("to.g").alias("sub_id"), F.col("to.at").alias("pos"), "m.relative", "m.size", "m.lines", "m.tokens")
    single = (members.join(stats.where(F.col("n") == 1).select(F.col("project").alias("_p"), F.col("chunk_id").alias("_c")),
                           F.col("project").eqNullSafe(F.col("_p")) & (F.col("chunk_id") == F.col("_c")), "left_semi")
              .select("project", "chunk_id", F.col("relative").alias("_r"), F.col("part_no").alias("_n")))
    pieces = retry_pieces(texts).select(F.col("project").alias("_p"), F.col("relative").alias("_of"), "member_part", F.col("part_no").alias("sub_id"),
                                        F.lit(0).alias("pos"), F.col("part_relative").alias("relative"), F.col("part_size").alias("size"),
                                        F.col("part_lines").alias("lines"), F.col("part_tokens").alias("tokens"))
    cut = single.join(pieces, F.col("project").eqNullSafe(F.col("_p")) & (F.col("_r") == F.col("_of")) & F.col("_n").eqNullSafe(F.col("member_part")))
    return multi.unionByName(cut.select(multi.columns))


def retry_pieces(texts: DataFrame) -> DataFrame:
    """The pieces of every text that a chunk of its own would be split into."""
    t2 = F.greatest(F.lit(K.RETRY_SPLIT_MIN_TARGET), F.floor(F.col("tokens") / 2)).cast("bigint")
    large = texts.where(F.col("tokens") > K.RETRY_SPLIT_MIN_TOTAL).select("project", "relative", F.col("part_no").alias("member_part"), "text", t2.alias("t2"))
    return part_rows(hard_split(large, split_width(F.col("t2"))), label="retry-part").where(F.col("part_count") > 1)


# ---------------------------------------------------------------- plan
def known_models() -> Column:
    """The known models as an array of (model, context)."""
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).cast("bigint").alias("context")) for m, c in K.MODEL_CONTEXTS.items()])


def chunk_plan(files: DataFrame, totals: DataFrame, policies: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Per project and model (policies: model, budget, delay; a table of
    the models asked about): chunks, fill rate (tokens / chunks x budget),
    least wall time = (chunks - 1) x delay.  The files are packed for all
    budgets in one pass; the budgets are few and come to the driver."""
    budgets = sorted(int(r[0]) for r in policies.select("budget").distinct().collect())
    counts = chunk_counts(files, [(b, max(K.MIN_SPLIT_CHARS, K.SPLIT_CHARS_PER_TOKEN * b)) for b in budgets], num_partitions)
    counted = counts.select(F.col("project").alias("_of"), "budget", "chunks")
    j = (totals.select("project", "files", "tokens")
         .join(counted, F.col("project").eqNullSafe(F.col("_of"))).drop("_of")
         .join(policies.select("model", F.col("budget").cast("bigint").alias("budget"), "delay"), "budget"))
    return j.select("project", "model", "files", "tokens", "chunks", "budget",
                    F.round(F.col("tokens") / (F.col("chunks") * F.col("budget")), 6).alias("fill_rate"),
                    F.round(F.greatest(F.col("chunks") - 1, F.lit(0)) * F.col("delay"), 6).alias("min_wall_sec"))
