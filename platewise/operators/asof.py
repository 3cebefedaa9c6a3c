"""Carry-forward ("last non-null value so far, per key") that splits hot keys.

``last(v, ignorenulls) OVER (PARTITION BY key ORDER BY t)`` sorts each key's
rows inside one task, so a key holding a third of the rows lands on one
executor.  Here the rows are range-partitioned on (key, t), which cuts a hot
key into several partitions, and the scan runs in two levels:

1. inside each (partition, key) slice, a window carries values forward
   (slices are bounded by the partition size);
2. each slice's last value is carried across partitions with a window over a
   table holding at most one row per (partition, key), i.e. at most
   ``num_partitions`` rows per key, and joined back to the slice rows that
   saw no value of their own yet.

The slice numbering is written once (reliable checkpoint), so both levels
read the same partition assignment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import materialize


def carry_forward(df: DataFrame, key: str, order_cols: list[str], value_col: str,
                  out_col: str, num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = last non-null ``value_col`` at or before each row
    (ordered by ``order_cols``, which must be unique within a key)."""
    ranged = (df.repartitionByRange(num_partitions, key, *order_cols) if num_partitions
              else df.repartitionByRange(key, *order_cols))      # AQE sizes the slices
    sliced = ranged.withColumn("_slice", F.spark_partition_id())
    w_local = (Window.partitionBy("_slice", key).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = materialize(sliced.withColumn("_local", F.last(value_col, ignorenulls=True).over(w_local)))
    # one row per (slice, key): the value a slice hands on to the next slice of its key
    ends = (local.groupBy("_slice", key)
            .agg(F.max_by("_local", F.struct(*order_cols)).alias("_end")))
    w_prev = (Window.partitionBy(key).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried_in = ends.select("_slice", key, F.last("_end", ignorenulls=True).over(w_prev).alias("_in"))
    return (local.join(carried_in, ["_slice", key], "left")
            .withColumn(out_col, F.coalesce(F.col("_local"), F.col("_in")))
            .drop("_slice", "_local", "_in"))


def min_after(df: DataFrame, key: str, order_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """Add ``out_col`` = least non-null ``value_col`` among the key's later rows
    (ordered by ``order_cols``, which must be unique within a key).

    The same two levels as :func:`carry_forward`, from the last row back.
    """
    sliced = df.repartitionByRange(key, *order_cols).withColumn("_slice", F.spark_partition_id())
    w_local = (Window.partitionBy("_slice", key).orderBy(*[F.desc(c) for c in order_cols])
               .rowsBetween(Window.unboundedPreceding, -1))
    local = materialize(sliced.withColumn("_local", F.min(value_col).over(w_local)))
    starts = local.groupBy("_slice", key).agg(F.min(value_col).alias("_start"))
    w_next = Window.partitionBy(key).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried_in = starts.select("_slice", key, F.min("_start").over(w_next).alias("_in"))
    return (local.join(carried_in, ["_slice", key], "left")
            .withColumn(out_col, F.least("_local", "_in"))   # least() skips nulls
            .drop("_slice", "_local", "_in"))


def previous(df: DataFrame, key: str, order_cols: list[str], value_col: str, out_col: str,
             num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = ``value_col`` of the key's row just before (null for its first row),
    ordered by ``order_cols``.

    The same two levels as :func:`carry_forward`: only a slice's first row of a
    key looks at the slices before.
    """
    ranged = (df.repartitionByRange(num_partitions, key, *order_cols) if num_partitions
              else df.repartitionByRange(key, *order_cols))
    w_local = Window.partitionBy("_slice", key).orderBy(*order_cols)
    local = materialize(ranged.withColumn("_slice", F.spark_partition_id())
                        .withColumn("_n", F.row_number().over(w_local)).withColumn("_local", F.lag(value_col).over(w_local)))
    ends = local.groupBy("_slice", key).agg(F.max_by(value_col, "_n").alias("_end"))
    carried_in = ends.withColumn("_in", F.lag("_end").over(Window.partitionBy(key).orderBy("_slice"))) \
        .select("_slice", key, "_in", F.lit(1).alias("_n"))
    return (local.join(carried_in, ["_slice", key, "_n"], "left")
            .withColumn(out_col, F.coalesce("_local", "_in")).drop("_slice", "_n", "_local", "_in"))
