"""Joins and groups of line ranges, without a nested loop.

``overlap_join`` pairs ranges of two tables that share a key and overlap.  A
range of n lines belongs to the level of the least power of two not below n,
and lies in at most two aligned bins of that level.  The shorter of two ranges
looks for the longer one: it also lies in at most two bins of every higher
level that the other table has.  So each pair meets in an equi-join on (key,
level, bin), in the bin of the later of the two starts and in no other.  A range
has at most two rows a level, whatever its length, and the sides meet in two
joins that split skewed keys like any other.  The levels of a table are asked for
when the join is built (a job on its ranges; at most 25 numbers come back), so
pass tables that are cheap to read.

``range_groups`` joins chains of overlapping ranges of a key into groups by a
running maximum of the ends over slices of a range partitioning, so that no
pairs are made and a key of any size is spread.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.plans.prefix import running_sums
from revlens.plans.session import shuffle_partitions

#: Levels up to 2**LEVELS lines; longer ranges are of the last level, in as many bins as they touch.
LEVELS = 24


def _level(lo: Column, hi: Column) -> Column:
    return F.least(F.lit(LEVELS), F.ceil(F.log2((hi - lo + 1).cast("double")))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels that a table has ranges of."""
    return sorted(r[0] for r in df.select(_level(F.col("_lo"), F.col("_hi")).alias("l")).distinct().collect())


def _bins(df: DataFrame, higher: list[int] | None) -> DataFrame:
    """One row per (level, bin) of each range: of its own level, or of those
    of the levels ``higher`` above it."""
    own = _level(F.col("_lo"), F.col("_hi"))
    levels = F.array(own) if higher is None else F.filter(F.array(*[F.lit(x) for x in higher]).cast("array<int>"), lambda x: x > own)
    at = df.select("*", F.explode(levels).alias("_level"))
    width = F.pow(F.lit(2.0), F.col("_level")).cast("bigint")
    return at.select("*", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("_bin"),
                     width.alias("_width"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str],
                 slack: int = 0) -> DataFrame:
    """Pairs of rows with equal keys (NULL equals NULL) whose closed ranges
    overlap, or lie at most ``slack`` lines apart.  Columns: those of left,
    then those of right but the keys; names must differ.  Ranges with a NULL
    end or their ends exchanged pair with nothing."""
    rest = [c for c in right.columns if c not in keys]
    lo, hi = left_range
    a = left.where(F.col(lo) <= F.col(hi)).select("*", (F.col(lo) - slack).cast("bigint").alias("_lo"), (F.col(hi) + slack).cast("bigint").alias("_hi"))
    b = right.where(F.col(right_range[0]) <= F.col(right_range[1])).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], *rest, F.col(right_range[0]).cast("bigint").alias("_lo"),
        F.col(right_range[1]).cast("bigint").alias("_hi"))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnsRenamed({c: f"_r{c}" for c in ("_lo", "_hi", "_level", "_bin", "_width")})
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_level") == F.col("_r_level"), F.col("_bin") == F.col("_r_bin")]
        over = (F.col("_lo") <= F.col("_r_hi")) & (F.col("_r_lo") <= F.col("_hi"))
        here = F.floor(F.greatest("_lo", "_r_lo") / F.col("_width")) == F.col("_bin")
        on = over & here
        for c in same:
            on = on & c
        return x.join(y, on).select(*left.columns, *rest)

    # left as long or longer: right looks in the levels from its own on; and the other way round, strictly
    own_b, higher_b = _bins(b, None), _bins(b, _levels(a))
    own_a, higher_a = _bins(a, None), _bins(a, _levels(b))
    return met(own_a, own_b.unionByName(higher_b)).unionByName(met(higher_a, own_b))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str],
                slack: int = 0) -> DataFrame:
    """The distinct (keys, range) of left that some range of right meets."""
    l = left.select(*keys, *left_range).distinct()
    r = right.select(*keys, *[F.col(c).alias(f"_of_{c}") for c in right_range]).distinct()
    met = overlap_join(l, r, keys, left_range, tuple(f"_of_{c}" for c in right_range), slack)
    return met.select(*keys, *left_range).distinct()


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest end so far within the key, for each row of a sorted slice
    (before it), and of the slice's rows of that key up to it."""
    key, reach = None, None
    for b in batches:
        keys, his = b.column(b.schema.get_field_index("_key")).to_pylist(), b.column(b.schema.get_field_index("_hi")).to_pylist()
        before, upto = [], []
        for k, h in zip(keys, his):
            if k != key:
                key, reach = k, None
            before.append(reach)
            reach = h if reach is None else max(reach, h)
            upto.append(reach)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), pa.array(upto, pa.int64())],
                                         names=[*b.schema.names, "_before", "_upto"])


def range_groups(df: DataFrame, keys: Sequence[str], lo: str, hi: str, slack: int = 0, name: str = "range_group") -> DataFrame:
    """Rows with the number (from 1, by start) of their chain of overlapping
    ranges within the key; at most ``slack`` lines may lie between.  Pass a
    narrow frame.  Rows without a whole range have no number."""
    spark = df.sparkSession
    ok = F.coalesce(F.col(lo) <= F.col(hi), F.lit(False))
    rows = df.where(ok).select("*", F.to_json(F.struct(*keys)).alias("_key"), F.col(lo).cast("bigint").alias("_lo"), F.col(hi).cast("bigint").alias("_hi"))
    # distinct ranges are ordered and cut; rows of one range share its number
    spans = rows.select("_key", "_lo", "_hi").distinct()
    ranged = (spans.repartitionByRange(shuffle_partitions(spark), "_key", "_lo", "_hi").sortWithinPartitions("_key", "_lo", "_hi")
              .withColumn("_slice", F.spark_partition_id()))
    local = ranged.mapInArrow(_reach, "_key string, _lo bigint, _hi bigint, _slice int, _before bigint, _upto bigint")
    # of earlier slices only the greatest end of a key counts: at most one key a slice goes on
    ends = local.groupBy("_slice", "_key").agg(F.max("_upto").alias("_end"))
    w = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("_slice", "_key", F.max("_end").over(w).alias("_earlier")).where("_earlier is not null")
    met = local.join(F.broadcast(earlier), ["_slice", "_key"], "left")
    reach = F.greatest(F.col("_before"), F.col("_earlier"))
    starts = met.select("_key", "_lo", "_hi", F.when(reach.isNull() | (F.col("_lo") > reach + slack), 1)
                        .otherwise(0).alias("_new"))
    numbered = running_sums(starts, "_key", ["_lo", "_hi"], {name: F.col("_new")}).select(
        F.col("_key").alias("_k"), F.col("_lo").alias("_l"), F.col("_hi").alias("_h"), name)
    grouped = (rows.join(numbered, (F.col("_key") == F.col("_k")) & (F.col("_lo") == F.col("_l")) & (F.col("_hi") == F.col("_h")))
               .select(*df.columns, name))
    return grouped.unionByName(df.where(~ok).withColumn(name, F.lit(None).cast("bigint")))
