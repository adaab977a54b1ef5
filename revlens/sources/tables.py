"""Readers for the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")
