"""Corpus operators: files table, filters, order, statistics, signatures.

A ``files`` frame has the columns
``project, path, relative, name, ext, size, lines, tokens, text``.
Statistics never carry ``text`` into a shuffle: Catalyst prunes it because
only the numeric columns are selected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.functions import text as X
from revlens.operators import chunking as D
from revlens.plans.prefix import ordinal

DIGEST_FANOUT = 4096


def file_order_cols() -> list[Column]:
    """Deterministic corpus order: lower(relative), then relative."""
    return [F.lower(F.col("relative")), F.col("relative")]


def corpus_from_table(df: DataFrame, project: str = "project", relative: str = "relative",
                      text: str = "text", tokens: Column | None = None) -> DataFrame:
    """A3: take a text table as a corpus (one row per file)."""
    base = df.select(F.col(project).alias("project"), F.col(relative).alias("relative"),
                     F.col(text).alias("text"))
    name = X.file_name(F.col("relative"))
    return base.select(
        "project",
        F.concat_ws("/", F.col("project"), F.col("relative")).alias("path"),
        "relative",
        name.alias("name"),
        X.suffix(name).alias("ext"),
        X.byte_size("text").alias("size"),
        X.file_loc("text").alias("lines"),
        (tokens if tokens is not None else X.token_estimate("text")).alias("tokens"),
        "text",
    )


def _dir_parts(relative: Column) -> Column:
    parts = F.split(relative, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def prune_dirs(files: DataFrame) -> DataFrame:
    """B1: drop files below an ignored directory or a directory starting
    with '.' (parts below the root, case-sensitive)."""
    dirs = _dir_parts(F.col("relative"))
    ignored = F.array(*[F.lit(d) for d in K.IGNORE_DIRS])
    return files.where(~F.arrays_overlap(dirs, ignored) & ~F.exists(dirs, lambda p: p.startswith(".")))


def keep_text_names(files: DataFrame) -> DataFrame:
    """B2: keep known text suffixes (lower-cased) and the special names; drop
    Thumbs.db / .DS_Store.  Hidden files are kept."""
    name = X.file_name(F.col("relative"))
    sfx = F.lower(X.suffix(name))
    ok = sfx.isin(*K.TEXT_EXTENSIONS) | name.isin(*K.SPECIAL_FILE_NAMES)
    return files.where(ok & ~name.isin(*K.IGNORE_FILES))


def reviewable(files: DataFrame) -> DataFrame:
    """B1 and B2, and of a scan only the files that could be read."""
    if "error" in files.columns:
        files = files.where(F.col("error").isNull())
    return keep_text_names(prune_dirs(files))


def with_file_order(files: DataFrame, name: str = "file_order") -> DataFrame:
    """1-based position of each file in its project, ordered by
    ``lower(relative), relative``; distributed (no per-project window)."""
    narrow = files.select("project", "relative")
    ords = ordinal(narrow, "project", file_order_cols(), name)
    return files.join(ords, ["project", "relative"])


def project_totals(files: DataFrame, folder: bool = False) -> DataFrame:
    """Files, bytes, LOC and tokens per project; with ``folder`` also the
    path of the project (the part of its files' paths before ``relative``)."""
    path = F.min(F.expr("left(path, length(path) - length(relative) - 1)")).alias("path")
    return files.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").cast("bigint").alias("size"),
        F.sum("lines").cast("bigint").alias("loc"),
        F.sum("tokens").cast("bigint").alias("tokens"), *([path] if folder else []))


def file_table(files: DataFrame) -> DataFrame:
    """Per-file row of the tokenizer report."""
    return files.select(
        "project", "relative", F.col("lines").alias("loc"), "tokens", "size",
        X.human_size(F.col("size")).alias("size_h"),
        F.coalesce(F.nullif(F.col("ext"), F.lit("")), F.lit("[no extension]")).alias("type"))


def language_of(ext: Column) -> Column:
    lut = F.create_map(*[x for kv in K.EXTENSION_LANGUAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.coalesce(F.element_at(lut, F.lower(ext)), F.lit(K.OTHER_LANGUAGE))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Files / bytes / LOC / tokens per (project, language) with ROLLUP
    subtotals per project and a grand total (level column names the grain)."""
    lang = files.select("project", language_of(F.col("ext")).alias("language"), "size", "lines", "tokens")
    agg = lang.rollup("project", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").cast("bigint").alias("size"),
        F.sum("lines").cast("bigint").alias("loc"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, "language").when(F.col("gid") == 1, "project").otherwise("total")
    return agg.select(F.col("project"), F.col("language"), level.alias("level"),
                      "files", "size", "loc", "tokens")


def context_fit(totals: DataFrame) -> DataFrame:
    """C4: per project and known model: can the project be sent whole?  The
    fixed models are an array per project (no join).  ``fits`` compares with
    the context, ``fits_budget`` with the share of it given to code;
    ``rank`` orders the models that fit by context (0: does not fit)."""
    tokens, context = F.col("tokens"), F.col("context")
    rows = totals.select("project", "tokens", F.inline(D.known_models()))
    fitting = F.size(F.filter(D.known_models(), lambda m: (m["context"] >= tokens) & (
        (m["context"] < context) | ((m["context"] == context) & (m["model"] < F.col("model"))))))
    return rows.select("project", "model", "context", "tokens", (tokens <= context).alias("fits"),
                       (tokens <= D.context_budget(context)).alias("fits_budget"),
                       F.when(tokens <= context, fitting + 1).otherwise(0).cast("int").alias("rank"))


def _join_ordered(ord_col: str, payload: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(payload).alias("p"))))
    return F.array_join(F.transform(items, lambda s: s["p"]), "|")


def ordered_digest(rows: DataFrame, keys: list[str], ord_col: str, payloads: dict[str, str],
                   fanout: int = DIGEST_FANOUT) -> DataFrame:
    """sha256 of the '|'-joined payloads in order, per key, for each payload
    column (``{output name: payload column}``) in one pass.

    Groups are bounded: payloads are hashed in blocks of ``fanout``
    consecutive rows, the block hashes the same way, four levels for every
    key whatever its number of rows: a key that grows keeps one meaning, and
    no group holds more than ``fanout`` payloads (up to fanout ** 4 rows).
    """
    names = list(payloads)
    lvl = rows.select(*keys, F.col(ord_col).alias("_o"), *[F.col(c).alias(n) for n, c in payloads.items()])
    for depth in range(4):
        last = depth == 3
        grp = [*keys] if last else [*keys, F.floor((F.col("_o") - 1) / fanout).alias("_b")]
        aggs = []
        for n in names:
            aggs.append(F.sha2(_join_ordered("_o", n), 256).alias(n))
        lvl = lvl.groupBy(*grp).agg(*aggs)
        if not last:
            lvl = lvl.withColumn("_o", F.col("_b") + 1).drop("_b")
    return lvl


def codebase_signature(files: DataFrame) -> DataFrame:
    """Signature of file metadata ``relative:size:lines:tokens`` in file
    order (content-blind), as a hash tree of fixed depth; plus a content
    digest beside it."""
    meta = files.select("project", "relative",
                        F.concat_ws(":", "relative", F.col("size").cast("string"), F.col("lines").cast("string"),
                                    F.col("tokens").cast("string")).alias("meta"),
                        F.sha2(F.col("text"), 256).alias("content"))
    ordered = ordinal(meta, "project", file_order_cols(), "file_order")
    return ordered_digest(ordered, ["project"], "file_order", {"signature": "meta", "content_sha256": "content"})
