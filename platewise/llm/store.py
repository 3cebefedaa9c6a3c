"""Intermediates written once to the shared folder, and Arrow helpers.

An intermediate that feeds several passes is written as Parquet below
``spark.checkpoint.dir`` (shared by driver and executors, see
``platewise.session.checkpoint_dir``) and read back, so a lost executor never
changes rows that were already used.  ``Scratch.drop`` removes a table as soon
as no later plan reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import checkpoint_dir

#: bytes of text that one vectorised step inside a task works on
SLICE_BYTES = 4 << 20
#: bytes of a Parquet row group: what a writing task holds
ROW_GROUP = 16 << 20
#: bits of a sieve, in words of 64: at most half a million rows are broadcast
SIEVE_BITS = 1 << 25


class Scratch:
    """A folder of intermediate tables in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads that copy."""
        target = f"{self.path}/{table}"
        df.write.option("parquet.block.size", ROW_GROUP).parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, table: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges whose texts together have about ``limit``
    bytes; a longer single text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(size)
    if len(sizes) > first:
        yield batch.slice(first)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large strings, null as the empty text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def fields(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """Columns of ``df``, followed by those of a DDL string."""
    return T.StructType([*(df.schema[c] for c in columns), *T.StructType.fromDDL(more).fields])


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is
    (a shuffled join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sieved(df: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have a key in ``keys``, and those that have none.

    A bit is set for each key's hash, ``SIEVE_BITS`` altogether, whose words are
    broadcast however many keys there are.  A join with ``keys`` then shuffles
    the first rows only; a few without a key are among them (one in 22 at
    1,500,000 keys).
    """
    slot = F.pmod(F.xxhash64(on), F.lit(SIEVE_BITS))
    word, bit = F.shiftright(slot, 6).alias("__word"), (slot % 64).cast("int").alias("__bit")
    words = keys.select(word, bit).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    marked = df.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(words), "__word", "left") \
        .withColumn("__hit", F.coalesce(F.getbit("__bits", F.col("__bit")) == 1, F.lit(False)))
    return tuple(marked.where(F.col("__hit") == hit).select(*(F.col(f"`{c}`") for c in df.columns)) for hit in (True, False))


def without(df: DataFrame, keys: DataFrame, on: str, few: int) -> DataFrame:
    """The rows of ``df`` without a key in ``keys``: at most ``few`` keys are
    broadcast, more meet the rows that the sieve leaves."""
    if keys.limit(few + 1).count() <= few:
        return df.join(F.broadcast(keys), on, "left_anti")
    doubtful, sure = sieved(df, keys, on)
    return sure.unionByName(doubtful.join(keys, on, "left_anti"))
