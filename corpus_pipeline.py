"""Training-data pipeline over ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
as the next one's docs.  The first four return the columns of documents.

1. toxicity: documents scored as toxic go.
2. SimHash near-dedup: one document of each group stays (the smallest doc_id;
   of rows that repeat it with the same fingerprint, one).
3. benchmark decontamination: the passages that hold benchmark windows are cut
   out of the texts; n_chars follows.  A document of which no letter or digit
   is left goes, if it had one.
4. secret scans: secrets in the texts are replaced; n_chars follows.
5. SentencePiece encoding: token ids of each text.

NULL texts pass all stages (no words, no hits, no tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontaminate, secret_scan, sentencepiece_sa, simhash, toxicity
from revlens.llm.components import written
from revlens.sources.tables import read_table

#: No DuckDB SQL: a trained forest, SimHash and SentencePiece are not
#: expressible; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars as the text now has."""
    return docs.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(decontaminate.cut(docs, read_table(spark, sf_dir, "benchmark")), docs.columns)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(secret_scan.redact(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_sa.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", replace_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the last stage's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
