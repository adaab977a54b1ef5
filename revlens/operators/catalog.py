"""Model catalogs: normalise model-list payloads, rank, search, page,
context lookup and membership.

Payloads are parsed into VARIANT once; items come out with
``posexplode`` and typed fields with ``try_variant_get``.  The known
context table is a fixed dimension of 17 rows (``constants.MODEL_CONTEXTS``),
broadcast by construction.
"""

from __future__ import annotations

import posixpath
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators.review import evaluate_once
from revlens.plans.prefix import ordinal
from revlens.plans.session import materialized, shuffle_partitions
from revlens.sources.corpus_tree import FileSystems, list_trees, open_file_system, read_contents


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _truthy_text(v: Column) -> Column:
    """Python truthiness of a JSON scalar, as text; null when falsy."""
    t = _vtype(v)
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | F.is_variant_null(v), None)
            .when(t == "BOOLEAN", F.when(s == "true", F.lit("True")))
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.when(F.length(s) > 2, s))
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"),
                  F.when(F.try_variant_get(v, "$", "double") != 0, s))
            .otherwise(F.when(s != "", s)))


def normalize_catalog(payloads: DataFrame, provider: str = "provider", payload: str = "payload",
                      key: str = "payload_id") -> DataFrame:
    """G1 + G2: one row per usable model item: provider, payload_id, pos,
    id, name, context (BIGINT, null when unknown), active.

    * gemini: ``models`` items; only those listing ``generateContent`` (or
      no list); ``models/`` stripped from the name; ``inputTokenLimit``.
    * ollama (local tags): ``models`` items with a name or model; no context.
    * anything else: a top-level array, else ``data`` when it is an array,
      else (only when ``data`` exists but is no array) ``models``; id = first
      truthy of id / name / model; ``active = false`` or ``archived = true``
      dropped; context = first truthy of seven paths.
    """
    # payloads are dealt to all tasks: a few row groups or files hold very many
    payloads = payloads.repartition(shuffle_partitions(payloads.sparkSession), key)
    v = F.try_parse_json(F.col(payload))
    df = evaluate_once(payloads.withColumn("_v", v), ["_v"])
    pv = F.col("_v")
    vt = _vtype(pv)
    data = F.variant_get(pv, "$.data", "variant")
    models = F.variant_get(pv, "$.models", "variant")
    generic = (F.when(vt.startswith("ARRAY"), pv)
               .when(vt.startswith("OBJECT") & data.isNull(), F.lit(None))
               .when(vt.startswith("OBJECT") & _vtype(data).startswith("ARRAY"), data)
               .when(vt.startswith("OBJECT"), models))
    items_v = (F.when(F.col(provider).isin("gemini", "ollama"),
                      F.when(vt.startswith("OBJECT"), models)).otherwise(generic))
    arr = F.try_variant_get(items_v, "$", "array<variant>")
    it = (df.select(F.col(provider).alias("provider"), F.col(key).alias("payload_id"),
                    F.posexplode(arr).alias("pos", "item"))
          .where(_vtype(F.col("item")).startswith("OBJECT")))
    item = F.col("item")
    g = lambda p: F.variant_get(item, p, "variant")

    # gemini
    methods = F.try_variant_get(item, "$.supportedGenerationMethods", "array<string>")
    gem_ok = (F.coalesce(F.size(methods), F.lit(0)) == 0) | F.array_contains(methods, "generateContent")
    gem_id = F.regexp_replace(F.coalesce(F.try_variant_get(item, "$.name", "string"), F.lit("")), "^models/", "")
    gem_name = F.coalesce(_truthy_text(g("$.displayName")), gem_id)
    gem_ctx = F.try_variant_get(item, "$.inputTokenLimit", "bigint")
    # ollama tags
    tag_id = F.coalesce(_truthy_text(g("$.name")), _truthy_text(g("$.model")))
    # generic
    gen_id = F.coalesce(_truthy_text(g("$.id")), _truthy_text(g("$.name")), _truthy_text(g("$.model")))
    inactive = ((_vtype(g("$.active")) == "BOOLEAN") & (F.try_variant_get(item, "$.active", "string") == "false")) | \
               ((_vtype(g("$.archived")) == "BOOLEAN") & (F.try_variant_get(item, "$.archived", "string") == "true"))
    gen_ctx = F.coalesce(*[F.nullif(F.try_variant_get(item, p, "bigint"), F.lit(0)) for p in K.CONTEXT_PATHS])
    gen_name = F.coalesce(_truthy_text(g("$.display_name")), _truthy_text(g("$.name")), gen_id)

    prov = F.col("provider")
    mid = F.when(prov == "gemini", gem_id).when(prov == "ollama", tag_id).otherwise(gen_id)
    keep = (F.when(prov == "gemini", gem_ok & (gem_id != ""))
            .when(prov == "ollama", tag_id.isNotNull())
            .otherwise(gen_id.isNotNull() & ~F.coalesce(inactive, F.lit(False))))
    name = F.when(prov == "gemini", gem_name).when(prov == "ollama", tag_id).otherwise(gen_name)
    ctx = (F.when(prov == "gemini", gem_ctx).when(prov == "ollama", F.lit(None).cast("bigint"))
           .otherwise(gen_ctx))
    return (it.where(keep)
            .select("provider", "payload_id", F.col("pos").cast("int").alias("pos"), mid.alias("id"),
                    name.alias("name"), ctx.cast("bigint").alias("context"), F.lit(True).alias("active")))


def read_catalogs(folders: DataFrame, pattern: str = "*.json", deep: bool = True,
                  file_systems: FileSystems = open_file_system) -> DataFrame:
    """A5: the model-list payload files (names like ``pattern``, one JSON
    document each) of a table of folders (provider, folder), with ``deep`` at
    any depth -> (provider, payload_id = file path, payload).  Tasks list the
    folders and read the files; the driver has no list of files.  A file that
    cannot be read fails the job."""
    listed = list_trees(folders.select(F.col("provider").alias("project"), F.col("folder").alias("root")), file_systems,
                        keep_name=lambda name: name[0] not in "._" and fnmatchcase(name, pattern),
                        keep_dir=lambda name: deep and name[0] not in "._")
    read = read_contents(listed, file_systems)
    text = F.when(F.col("error").isNull(), F.col("content").cast("string")).otherwise(
        F.raise_error(F.concat_ws(": ", "path", "error")).cast("string"))
    return read.select(F.col("project").alias("provider"), F.col("path").alias("payload_id"), text.alias("payload"))


def read_catalog(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """A5 of one provider: a folder, a file, or a folder and a name with
    wildcards."""
    folder, name = posixpath.split(path.rstrip("/"))
    if not name.endswith(".json") and not set(name) & set("*?["):
        folder, name = path, "*"
    return read_catalogs(spark.createDataFrame([(provider, folder)], "provider string, folder string"), name, deep=False)


def _penalty(model_id: Column) -> Column:
    low = F.lower(model_id)
    hit = F.lit(False)
    for term in K.NON_CHAT_TERMS:
        hit = hit | low.contains(term)
    return F.when(hit, 1).otherwise(0)


def rank_models(models: DataFrame) -> DataFrame:
    """Per provider: chat models first, larger context first, then
    lower(id); ties keep arrival order.  Adds ``model_rank``.  The models are
    written before they are ordered: the bounds of the ranges and the ranges
    both read them, and they come out of parsed payloads."""
    base = materialized(models, "models")
    base = base.select("*", _penalty(F.col("id")).alias("penalty"),
                         F.coalesce(F.col("context"), F.lit(0)).alias("ctx0"))
    return ordinal(base, "provider", [F.col("penalty"), -F.col("ctx0"), F.lower(F.col("id")),
                                      F.col("payload_id"), F.col("pos")], "model_rank").drop("ctx0")


def search_models(ranked: DataFrame, text: str, limit: int = K.SEARCH_LIMIT) -> DataFrame:
    """Case-insensitive substring of id or name; the first ``limit``
    matches in rank order (a top-k report)."""
    q = text.lower()
    hits = ranked.where(F.lower(F.col("id")).contains(q) | F.lower(F.col("name")).contains(q))
    hits = ordinal(hits, "provider", [F.col("model_rank")], "match_rank")
    return hits.where(F.col("match_rank") <= limit)


def model_page(ranked: DataFrame, page: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """Page ``page`` (0-based) of the ranked list: a band of ranks."""
    lo = page * size
    return ranked.where((F.col("model_rank") > lo) & (F.col("model_rank") <= lo + size))


def known_contexts(spark: SparkSession) -> DataFrame:
    rows = [(k, int(v)) for k, v in K.MODEL_CONTEXTS.items()]
    return spark.createDataFrame(rows, "known_id string, known_context bigint")


def context_lookup(requests: DataFrame, model: str = "model", live: str | None = None) -> DataFrame:
    """Context for each requested model: a live value if truthy, else
    the exact known id, else the case-insensitive known id (first in table
    order), else 8,192.  Both lookups are broadcast joins to the fixed
    17-row table."""
    spark = requests.sparkSession
    known = known_contexts(spark)
    exact = F.broadcast(known.select(F.col("known_id").alias("_k"), F.col("known_context").alias("_exact")))
    folded_rows = [(k.lower(), int(v)) for k, v in reversed(list(K.MODEL_CONTEXTS.items()))]
    folded_map = dict(folded_rows)  # first in table order wins
    folded = F.broadcast(spark.createDataFrame(list(folded_map.items()), "_f string, _folded bigint"))
    key = F.trim(F.col(model))
    r = requests.withColumn("_key", key)
    r = r.join(exact, r["_key"] == exact["_k"], "left").join(folded, F.lower(r["_key"]) == folded["_f"], "left")
    live_col = F.nullif(F.col(live), F.lit(0)) if live else F.lit(None).cast("bigint")
    src = (F.when(live_col.isNotNull(), "live").when(F.col("_exact").isNotNull(), "exact")
           .when(F.col("_folded").isNotNull(), "case_insensitive").otherwise("default"))
    out = r.withColumn("context_assumed",
                       F.coalesce(live_col, F.col("_exact"), F.col("_folded"), F.lit(K.DEFAULT_CONTEXT)).cast("bigint"))
    return out.withColumn("context_source", src).drop("_key", "_k", "_exact", "_f", "_folded")


def in_active_list(requests: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """Is each requested model id (exactly) in the provider's active
    list; the live context of the match comes along (left join on a
    de-duplicated list)."""
    active = models.groupBy("provider", "id").agg(F.max("context").alias("live_context"))
    j = requests.join(active, (requests[model] == active["id"]) & (requests["provider"] == active["provider"]), "left")
    return j.select(requests["*"], active["id"].isNotNull().alias("active"), "live_context")
