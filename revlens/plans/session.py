"""Session helpers: checkpoint directory and partition sizing."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only in local mode may it be unset, and a folder
    of our own is set then.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        conf = tempfile.mkdtemp(prefix="revlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint root for written intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{os.getpid()}-{os.urandom(4).hex()}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet below the checkpoint root and read again:
    cuts the lineage, survives lost executors, and computes the input once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int | str = "*", app: str = "revlens", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench (local mode)."""
    return (SparkSession.builder.master(f"local[{cpus}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", "16g")
            .config("spark.ui.enabled", "false")
            .getOrCreate())
