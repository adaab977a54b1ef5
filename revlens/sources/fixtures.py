"""Derived views over the driver tables (see FIXTURES.md section 3).

Each builder returns a lazy DataFrame derived from the given tables, so work
grows with them: a corpus (``files_v``), raw model replies (``responses_v``),
an attempt log (``attempts_v``), model-list payloads (``catalog_v``), secret
values (``secrets_v``) and an earlier corpus snapshot (``snapshot_v``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources.tables import read_table

NL = "\n"


def files_v(spark: SparkSession, data_dir: str) -> DataFrame:
    d = read_table(spark, data_dir, "documents")
    did = F.col("doc_id")
    folder = (F.when(did % 23 == 0, "node_modules/").when(did % 29 == 0, ".cache/").otherwise("src/"))
    ext = (F.when(did % 31 == 0, ".bin").when(F.col("lang") == "en", ".py")
           .when(F.col("lang") == "fr", ".js").when(F.col("lang") == "de", ".HTML").otherwise(".sql"))
    docs = d.select(F.col("source").alias("project"),
                    F.concat(folder, F.lit("Doc_"), did.cast("string"), ext).alias("relative"),
                    F.col("text"))
    p = read_table(spark, data_dir, "pages")
    pages = p.select(F.concat(F.lit("site"), (F.col("page_id") % 5).cast("string")).alias("project"),
                     F.concat(F.lit("html/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("relative"),
                     F.col("html").alias("text"))
    return docs.unionByName(pages)


def responses_v(spark: SparkSession, data_dir: str) -> DataFrame:
    return replies_from_documents(read_table(spark, data_dir, "documents"))


def replies_from_documents(d: DataFrame, *kept: str) -> DataFrame:
    """Model-style replies derived row by row from ``documents`` (also on a
    stream), with the columns named besides."""
    did = F.col("doc_id")
    sev = (F.when(did % 7 == 0, "Critical").when(did % 7 == 1, "High").when(did % 7 == 2, "Medium")
           .when(did % 7 == 3, "Low").when(did % 7 == 4, "Info").otherwise("high"))
    line = F.when(did % 9 == 0, F.lit('"12-15"')).otherwise((did % 50).cast("string"))
    f = F.concat(F.lit('{"category":"Quality","severity":"'), sev, F.lit('","file":"src/Doc_'),
                 (did % 40).cast("string"), F.lit('","line":'), line,
                 F.lit(',"title":"long line","confidence":"Low"}'))
    j = F.concat(F.lit('{"summary":"doc '), did.cast("string"), F.lit('","findings":['), f,
                 F.when(did % 4 == 0, F.concat(F.lit(","), f)).otherwise(F.lit("")),
                 F.lit('],"positive_points":["lang '), F.col("lang"),
                 F.lit('"],"recommendations":["split long lines"]}'))
    m = did % 6
    raw = (F.when(m == 0, j).when(m == 1, F.concat(F.lit("```json" + NL), j, F.lit(NL + "```")))
           .when(m == 2, F.concat(F.lit("Here is the review: "), j, F.lit(" Done.")))
           .when(m == 3, F.lit("")).when(m == 4, F.lit("no issues found")).otherwise(j))
    return d.select(F.col("source").alias("project"), did.alias("chunk_id"), raw.alias("raw"),
                    F.col("n_chars").alias("prompt_tokens"), (F.col("n_chars") % 400).alias("completion_tokens"), *kept)


def attempts_v(spark: SparkSession, data_dir: str) -> DataFrame:
    return attempts_from_events(read_table(spark, data_dir, "events"))


def attempts_from_events(e: DataFrame) -> DataFrame:
    """The attempt log derived row by row from ``events`` (also on a stream)."""
    et = F.col("event_type")
    status = (F.when(et == "error", 429).when(et == "purchase", 503).when(et == "signup", 400)
              .when(et == "view", 200).otherwise(F.lit(None).cast("int")))
    detail = (F.when(et == "signup", "maximum context exceeded").when(et == "click", "connection reset")
              .otherwise(""))
    return e.select(
        "event_id", "ts",
        F.concat(F.lit("prov"), (F.col("user_id") % 4).cast("string")).alias("provider"),
        F.col("user_id").alias("chunk_id"),
        (1 + F.col("event_id") % 5).alias("attempt"),
        status.alias("status"), detail.alias("detail"),
        F.when(F.col("event_id") % 7 == 0, F.col("value")).otherwise(F.lit(None).cast("double")).alias("retry_after"),
        F.floor(F.col("value") * 100).cast("bigint").alias("tokens"))


def chunk_attempts_v(spark: SparkSession, data_dir: str) -> DataFrame:
    """The attempt log by chunk of the documents' corpus: project and chunk
    from the event, more refusals and server errors than ``attempts_v``."""
    e, a = F.col("event_id"), attempts_v(spark, data_dir)
    refused, down = e % 11 == 0, (F.col("status") == 200) & (e % 3 != 0)
    return a.select("event_id", "ts", F.concat(F.lit("src"), (F.col("chunk_id") % 20).cast("string")).alias("project"),
                    (1 + e % 50).alias("chunk_id"), F.when(refused, 401).when(down, 500).otherwise(F.col("status")).alias("status"),
                    F.when(refused, "invalid key").when(down, "server error").otherwise(F.col("detail")).alias("detail"))


def catalog_v(spark: SparkSession, data_dir: str) -> DataFrame:
    p = read_table(spark, data_dir, "part")
    k = F.col("p_partkey")
    name, size = F.col("p_name"), F.col("p_size")
    gemini = F.concat(F.lit('{"models":[{"name":"models/'), name, F.lit('","inputTokenLimit":'),
                      (size * 1000).cast("string"), F.lit(',"supportedGenerationMethods":["'),
                      F.when(k % 8 == 0, "embedContent").otherwise("generateContent"), F.lit('"]}]}'))
    ollama = F.concat(F.lit('{"models":[{"name":"'), name, F.lit('"}]}'))
    generic = F.concat(F.lit('{"data":[{"id":"'), name, F.lit('","context_window":0,"context_length":'),
                       (size * 1000).cast("string"), F.lit(',"active":'),
                       F.when(size % 5 == 0, "false").otherwise("true"), F.lit("}]}"))
    bare = F.concat(F.lit('[{"id":"'), name, F.lit('","top_provider":{"context_length":'),
                    (size * 100).cast("string"), F.lit("}}]"))
    m = k % 4
    provider = F.when(m == 0, "gemini").when(m == 1, "ollama").otherwise("generic")
    payload = F.when(m == 0, gemini).when(m == 1, ollama).when(m == 2, generic).otherwise(bare)
    return p.select(k.alias("payload_id"), provider.alias("provider"), payload.alias("payload"))


SECRET_PATTERN = r'token = "([0-9a-f]{40})"'


def secrets_v(spark: SparkSession, data_dir: str) -> DataFrame:
    d = read_table(spark, data_dir, "documents")
    found = F.regexp_extract_all(F.col("text"), F.lit(SECRET_PATTERN), F.lit(1))
    return (d.select("doc_id", F.col("source").alias("owner"), F.explode(found).alias("found"))
            .select("doc_id", "owner", F.concat(F.lit("Bearer "), F.col("found")).alias("value")))


def snapshot_v(spark: SparkSession, data_dir: str) -> DataFrame:
    d = read_table(spark, data_dir, "documents")
    did = F.col("doc_id")
    text = F.when(did % 7 == 0, F.concat(F.col("text"), F.lit(NL + "edited"))).otherwise(F.col("text"))
    return d.where(did % 10 != 3).select(F.col("source").alias("project"), did, text.alias("text"))
