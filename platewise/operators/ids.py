"""Contiguous id assignment without AUTO_INCREMENT and without a global sort
into one partition.

Rows are range-partitioned on a unique, stable key; each partition numbers
its rows locally; the per-partition counts (one row per partition, so their
size is bounded by the partition count, not the data) are prefix-summed and
broadcast back.  The result is ``start + global rank by key``: contiguous,
deterministic, and independent of the partition count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.session import checkpoint_dir


def assign_ids(df: DataFrame, order_cols: list[str], start: Column | int = 0,
               id_col: str = "id", num_partitions: int | None = None,
               block_size_col: str | None = None, block_start: Column | int = 0,
               block_col: str = "block_start") -> DataFrame:
    """Add ``id_col`` = ``start`` + 1-based rank of ``order_cols`` (must be unique).

    ``start`` may be a scalar Column such as ``next_id_after(existing)``.

    With ``block_size_col`` every row also reserves that many consecutive ids
    of a second sequence: ``block_col`` is the first of them
    (``block_start`` + sizes of all earlier rows + 1).  Child rows (e.g. the
    ingredients of a dish request) then take ``block_col + position`` without
    a second numbering pass.

    The range-partitioned, locally numbered rows are written once with a
    reliable ``checkpoint()`` (into ``spark.checkpoint.dir``): both the
    per-partition counts and the final ids read that one copy, so a retried
    task or a lost executor can never renumber rows (a range partitioner
    re-sampled on recomputation could).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    start_c = start if isinstance(start, Column) else F.lit(start)
    # without a fixed count AQE sizes the range exchange from the data; merging
    # adjacent range partitions keeps the order, so ids stay ordered by key
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols))
    numbered = (ranged
                .sortWithinPartitions(*order_cols)
                # partition index in the high bits, position in the partition in the low 33 bits
                .withColumn("_mid", F.monotonically_increasing_id())
                .checkpoint(eager=True))
    numbered = (numbered.withColumn("_pid", F.shiftright("_mid", 33))
                .withColumn("_rn", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
                .drop("_mid"))
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if block_size_col:
        aggs.append(F.sum(F.col(block_size_col).cast("long")).alias("_bsum"))
        # running block sizes inside each partition slice (a slice is bounded by the partition size)
        w_in = Window.partitionBy("_pid").orderBy("_rn").rowsBetween(Window.unboundedPreceding, -1)
        numbered = numbered.withColumn(
            "_bin", F.coalesce(F.sum(F.col(block_size_col).cast("long")).over(w_in), F.lit(0)))
    counts = numbered.groupBy("_pid").agg(*aggs)
    # a table with one row per partition: its window runs on a bounded input
    w_prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("_cnt").over(w_prev), F.lit(0)).alias("_off")]
    if block_size_col:
        offs.append(F.coalesce(F.sum("_bsum").over(w_prev), F.lit(0)).alias("_boff"))
    offsets = counts.select("_pid", *offs)
    out = (numbered.join(F.broadcast(offsets), "_pid")
           .withColumn(id_col, (F.coalesce(start_c, F.lit(0)) + F.col("_off") + F.col("_rn")).cast("long")))
    if block_size_col:
        b0 = block_start if isinstance(block_start, Column) else F.lit(block_start)
        out = (out.withColumn(block_col, (F.coalesce(b0, F.lit(0)) + F.col("_boff") + F.col("_bin") + 1)
                              .cast("long"))
               .drop("_boff", "_bin"))
    return out.drop("_pid", "_rn", "_off")


def next_id_after(existing: DataFrame, col: str = "id") -> Column:
    """Scalar column: current maximum id (0 when the table is empty)."""
    return F.coalesce(existing.select(F.max(col)).scalar(), F.lit(0))
