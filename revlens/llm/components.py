"""Connected components of a link table by alternating large and small stars.

Every round is two joins and two aggregations over the links left; its result
is checkpointed under ``spark.checkpoint.dir``.  A node with very many links
is one key of a join that Spark can split, and of minima combined before the
shuffle.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans.session import ensure_checkpoint_dir, scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet below the shared checkpoint folder and
    read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(e: DataFrame) -> DataFrame:
    sym = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))     # here always v < u
    other = e.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return other.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has a link to another node; the
    component is the smallest node reachable."""
    ensure_checkpoint_dir(links.sparkSession)
    e = (links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()).checkpoint()
    state = _state(e)
    while state[0]:
        e = _small_star(_large_star(e)).checkpoint()
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
