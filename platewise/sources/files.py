"""File sources and sinks: text lines, address CSV, JSON arrays, WKB points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.session import materialize

ADDRESS_SCHEMA = T.StructType([
    T.StructField("street", T.StringType()),
    T.StructField("no", T.StringType()),
    T.StructField("zip", T.StringType()),
    T.StructField("city", T.StringType()),
])


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, surrounding whitespace removed (Python ``strip()``)."""
    return spark.read.text(path).select(
        F.regexp_replace("value", r"^\s+|\s+$", "").alias("value"))


def format_address(street, no, zip_code, city):
    """``st. {street} {no}, {city}, {zip}``."""
    return F.concat(F.lit("st. "), street, F.lit(" "), no, F.lit(", "), city, F.lit(", "), zip_code)


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """``street,no,zip,city`` lines (no header) -> formatted address text."""
    df = spark.read.schema(ADDRESS_SCHEMA).option("header", "false").csv(path)
    return df.select("*", format_address(F.col("street"), F.col("no"), F.col("zip"), F.col("city"))
                     .alias("address"))


def write_json_arrays(df: DataFrame, path: str, rows_per_array: int = 1024) -> None:
    """Write rows as JSON arrays of at most ``rows_per_array`` objects, one array
    per line, in the partitions and the order the rows have (no shuffle)."""
    if rows_per_array < 1:
        raise ValueError("rows_per_array must be at least 1")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        for batch in batches:
            waiting += batch.column(0).to_pylist()
            full = len(waiting) // rows_per_array * rows_per_array
            lines = ["[" + ",".join(waiting[i:i + rows_per_array]) + "]" for i in range(0, full, rows_per_array)]
            waiting = waiting[full:]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array(["[" + ",".join(waiting) + "]"], pa.string())], names=["value"])

    text = F.to_json(F.struct(*df.columns)).alias("value")
    df.select(text).mapInArrow(arrays, "value string").write.mode("overwrite").text(path)


def write_json_files(df: DataFrame, path: str) -> None:
    """Write rows as one indented JSON array of objects per file (a file a partition)."""
    def array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            lines = [("" if first and not i else ",\n") + text for i, text in enumerate(batch.column(0).to_pylist())]
            if lines:
                lines[0] = ("[\n" if first else "") + lines[0]
                first = False
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])

    text = F.to_json(F.struct(*df.columns), {"pretty": "true"})
    df.select(text.alias("value")).mapInArrow(array, "value string").write.mode("overwrite").text(path)


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType,
                     whole_file: bool = False) -> DataFrame:
    """Rows from JSON arrays of objects: one array per line (splittable) or,
    with ``whole_file``, arrays that go over many lines (see :func:`json_objects`)."""
    if not whole_file:
        return spark.read.schema(schema).json(path)
    return json_objects(spark, path).select(F.from_json("json", schema).alias("_row")).select("_row.*")


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the file's earlier pieces: within a byte range by a window (a range is
    bounded), over the ranges before by one over a row a range."""
    here = Window.partitionBy("file", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("file", "start").agg(F.sum(value).alias("_all"))
    ranges = ranges.select("file", "start", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    return (df.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0))).join(ranges, ["file", "start"])
            .withColumn(out, F.col("_here") + F.col("_before")).drop("_here", "_before"))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects (``json``, text) of arrays that fill whole files, one file read by many tasks.

    A file is read by byte ranges in pieces that end at a closing brace.
    Whether a brace stands inside a string depends on all quotes before it,
    and whether it ends an object on all braces before it: running sums over
    the file, taken within each range and over one row a range.  The pieces of
    an object are put together wherever they were read.  What is outside of
    objects (brackets, commas, space, values that are no objects) is left out,
    as is an object without end.  Empty files and empty arrays have no rows.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                         F.monotonically_increasing_id().alias("at"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")          # without escaped characters
    outside = lambda text: F.regexp_replace(text, r'(?s)"[^"]*("|$)', "")
    pieces = materialize(pieces.withColumns({
        "quotes": F.regexp_count(plain, F.lit('"')),
        "opened": F.regexp_count(outside(plain), F.lit(r"\{")),                             # if it begins outside of a string
        "opened_within": F.regexp_count(outside(F.concat(F.lit('"'), plain)), F.lit(r"\{"))}))  # if it begins inside
    known = _running(pieces, "quotes", "quotes_before").withColumn("within", F.col("quotes_before") % 2 == 1)
    closes = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    known = known.withColumn("depth", F.when(F.col("within"), F.col("opened_within")).otherwise(F.col("opened")) - closes.cast("int"))
    ends = _running(known, "depth", "depth_before").withColumn(
        "ends", (closes & (F.col("depth_before") + F.col("depth") == 0) & (F.col("depth_before") + F.col("depth") + 1 > 0)).cast("int"))
    ends = materialize(ends.select("file", "start", "at", "value", "depth", "depth_before", "ends"))
    numbered = _running(ends, "ends", "object")
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "value"))), lambda p: p["value"]), "}"), F.lit("}"))
    objects = numbered.groupBy("file", "object").agg(text.alias("json"), F.max("ends").alias("ended"))
    return objects.where("ended = 1").select(F.regexp_replace("json", r"(?s)^[^{]*", "").alias("json"))


def rows_as_json(df: DataFrame, col: str = "json") -> DataFrame:
    """Each row as one JSON object string (the reference's JSON answer)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(col))


# -- POINT values: 4-byte SRID + little-endian WKB (1 + 4 + 8 + 8 bytes) --------------

_POINT_LEN = 25


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def decode_point(blobs: pd.Series) -> pd.DataFrame:
    """Vectorised decode of POINT blobs (either byte order) to (x, y); anything else -> NULLs."""
    n = len(blobs)
    x = np.full(n, np.nan)
    y = np.full(n, np.nan)
    ok = blobs.map(lambda b: b is not None and len(b) == _POINT_LEN).to_numpy(dtype=bool)
    if ok.any():
        raw = np.frombuffer(b"".join(bytes(b) for b in blobs[ok]), dtype=np.uint8).reshape(-1, _POINT_LEN)
        known = np.zeros(len(raw), dtype=bool)
        for order, mark in (("<", 1), (">", 0)):
            mine = (raw[:, 4] == mark) & (raw[:, 5:9].copy().view(f"{order}u4").ravel() == 1)    # a point
            at = np.flatnonzero(ok)[mine]
            x[at] = raw[mine, 9:17].copy().view(f"{order}f8").ravel()
            y[at] = raw[mine, 17:25].copy().view(f"{order}f8").ravel()
            known |= mine
        ok[np.flatnonzero(ok)[~known]] = False
    out = pd.DataFrame({"x": x, "y": y})
    out[~ok] = None
    return out


@F.pandas_udf(T.BinaryType())
def encode_point(x: pd.Series, y: pd.Series) -> pd.Series:
    """Vectorised encode of (x, y) to a POINT blob with SRID 0."""
    n = len(x)
    raw = np.zeros((n, _POINT_LEN), dtype=np.uint8)
    raw[:, 4] = 1                                   # little endian
    raw[:, 5:9] = np.frombuffer(np.uint32(1).tobytes(), dtype=np.uint8)   # type 1 = POINT
    raw[:, 9:17] = x.to_numpy(dtype="<f8").reshape(-1, 1).view(np.uint8)
    raw[:, 17:25] = y.to_numpy(dtype="<f8").reshape(-1, 1).view(np.uint8)
    return pd.Series([r.tobytes() for r in raw])
