"""Reply readers and result / report writers.

Result tables go through Spark's file commit protocol (tasks write attempt
files, the job commit publishes them), report pages through ``report_files``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import text as X
from revlens.sources.report_files import write_pages

REPLY_SCHEMA = ("project string, chunk_id bigint, signature string, attempt int, raw string, "
                "usage map<string,double>")


def read_replies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A4: raw model replies with usage: JSON lines (explicit schema, no
    inference) or parquet."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(REPLY_SCHEMA).json(path)


def write_review(reviews: DataFrame, findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Review records and ranked findings as parquet, partitioned by
    project."""
    root = path.rstrip("/")
    reviews.write.mode(mode).partitionBy("project").parquet(f"{root}/reviews")
    findings.write.mode(mode).partitionBy("project").parquet(f"{root}/findings")


def report_names(reviews: DataFrame, when: datetime | None = None) -> DataFrame:
    """(project, report): file names ``subject-provider-model-time.html`` of
    safe names.  Projects whose safe names are equal get a part of their hash
    behind the subject, but for the first."""
    stamp = (when or datetime.now(timezone.utc)).strftime("%Y%m%d-%H%M%S")
    subject = X.safe_name(F.col("project"))
    named = reviews.select("project", subject.alias("subject"), X.safe_name(F.col("provider")).alias("p"),
                           X.safe_name(F.col("model")).alias("m"))
    first = named.groupBy("subject").agg(F.min("project").alias("first"))
    own = F.when(F.col("project").eqNullSafe(F.col("first")), F.col("subject")).otherwise(
        F.concat_ws("-", "subject", F.substring(F.sha2(F.coalesce("project", F.lit("")), 256), 1, 8)))
    return named.join(first, "subject").select("project", F.concat(F.concat_ws("-", own, "p", "m", F.lit(stamp)), F.lit(".html")).alias("report"))


def write_reports(rows: DataFrame, reviews: DataFrame, path: str, num_partitions: int | None = None,
                  when: datetime | None = None) -> DataFrame:
    """One HTML document per project below ``path``, of its rows (project,
    section, seq, html) in order, one row a line.  Returns the names."""
    names = report_names(reviews, when)
    of = names.select(F.col("project").alias("of"), "report")
    write_pages(rows.join(of, F.col("project").eqNullSafe(F.col("of"))), path, num_partitions)
    return names
