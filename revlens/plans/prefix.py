"""Running sums within a key, without a single-task window.

``Window.partitionBy(key).orderBy(...)`` sends every row of one key to one
task.  A corpus may hold one project with a third of all files, so ordinals,
running token sums and chunk numbering use this primitive instead, the same
way for keys of every size:

1. range-partition the narrow rows on (key, order) -> a hot key spreads over
   many partitions, each a contiguous slice of the global order;
2. cumulate inside each partition (Arrow batches, carry between batches);
3. sum per (partition, key); the offset of a slice is the sum of the earlier
   slices of the same key.  Only keys that continue from an earlier partition
   need an offset, so that table has fewer rows than there are partitions:
   a proven bound, safe to broadcast.

The order must be total within the key (add a unique tie-breaker).  No job
runs while the DataFrame is built, unless the caller asks for a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.plans.session import ensure_checkpoint_dir, shuffle_partitions

_PID, _KEY = "_rs_pid", "_rs_key"


def _cumulate(names: Sequence[str]):
    """Running sums of one partition; its rows are sorted by key and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(names, 0)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(_KEY))
            new = np.empty(b.num_rows, dtype=bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            heads, part = np.flatnonzero(new), np.cumsum(new)
            sums = []
            for n in names:
                v = pc.fill_null(b.column(b.schema.get_field_index(n)), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(v)
                base = np.concatenate([[-carry[n]], upto[heads] - v[heads]])
                sums.append(upto - base[part])
                carry[n] = int(sums[-1][-1])
            last = keys[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(s, pa.int64()) for s in sums]],
                                             names=[*b.schema.names, *["_rs_loc_" + n for n in names]])

    return run


def running_sums(df: DataFrame, key: str, order: Sequence[Column | str],
                 values: Mapping[str, Column], num_partitions: int | None = None,
                 materialize: bool = False) -> DataFrame:
    """Return ``df`` plus one inclusive running-sum column per entry of
    ``values`` (BIGINT, NULL counts as 0), within ``key`` in ``order``; NULL
    is a key like any other.  Pass a narrow frame (keys, order columns, small
    values).

    The slices are read twice (sums, join) from one range exchange, which
    Spark reuses.  ``materialize`` writes them to the session's checkpoint
    directory instead (for iterative callers); so does a session that has
    switched the reuse of exchanges off, as the bounds are sampled."""
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    # a key that is never NULL, so that slices and offsets compare plainly
    base = df.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    order_cols = [f"_rs_o{i}" for i in range(len(order))]
    base = base.withColumns({c: F.col(o) if isinstance(o, str) else o for c, o in zip(order_cols, order)})
    names = list(values)
    base = base.withColumns({name: col.cast("bigint") for name, col in values.items()})
    ranged = (base.repartitionByRange(n, _KEY, *order_cols)
              .sortWithinPartitions(_KEY, *order_cols)
              .drop(*order_cols).withColumn(_PID, F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField("_rs_loc_" + v, T.LongType(), False) for v in names])
    local = ranged.mapInArrow(_cumulate(names), schema)
    if materialize or spark.conf.get("spark.sql.exchange.reuse", "true") != "true":
        ensure_checkpoint_dir(spark)
        local = local.checkpoint(eager=True)
    totals = local.groupBy(_PID, _KEY).agg(*[F.sum(v).alias("_rs_tot_" + v) for v in names])
    w = Window.partitionBy(_KEY).orderBy(_PID)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals
               .select(_PID, _KEY, F.row_number().over(w).alias("_rs_rn"),
                       *[F.sum("_rs_tot_" + v).over(earlier).alias("_rs_off_" + v) for v in names])
               .where(F.col("_rs_rn") > 1)          # at most one row per partition boundary
               .drop("_rs_rn"))
    out = local.join(F.broadcast(offsets), [_PID, _KEY], "left")
    sums = {v: F.col("_rs_loc_" + v) + F.coalesce(F.col("_rs_off_" + v), F.lit(0)) for v in names}
    return out.select(*[c for c in df.columns if c not in sums], *[c.alias(v) for v, c in sums.items()])


def ordinal(df: DataFrame, key: str, order: Sequence[Column | str], name: str = "ord",
            num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``key`` in ``order`` (distributed)."""
    return running_sums(df, key, order, {name: F.lit(1)}, num_partitions)
