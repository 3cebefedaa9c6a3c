"""Streaming forms agree with the batch folds, also across several
micro-batches with a late command."""

import datetime as dt
import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from platewise.operators import moderation
from platewise.streaming import commands as streams

T0 = dt.datetime(2025, 1, 1)
LOC_SCHEMA = ("id long, verified boolean, lat double, lon double, pending_lat double, pending_lon double, "
              "updated_by long, verified_by long, edited_by long")
CMD_COLS = ["event_id", "ts", "key", "action", "actor", "p_lat", "p_lon"]


def _write(dirpath, name, rows):
    cols = list(zip(*rows))
    table = pa.table({c: list(v) for c, v in zip(CMD_COLS, cols)})
    pq.write_table(table, os.path.join(dirpath, name))
    time.sleep(1.1)   # file sources order new files by modification time


def test_stream_locations_multi_batch_with_late_command(spark):
    coords = spark.createDataFrame([(1, True, 51.1, 17.0, 0.0, 0.0, 3, 0, 0),
                                    (2, False, 51.2, 17.1, 51.25, 17.15, 4, 0, 6)], LOC_SCHEMA)
    m = lambda i: T0 + dt.timedelta(minutes=i)
    b1 = [(1, m(1), 1, "UPDATE", 7, 51.3, 17.3), (2, m(2), 2, "VER", 1, 0.0, 0.0)]
    b2 = [(3, m(5), 1, "VER", 1, 0.0, 0.0), (4, m(6), 2, "UPDATE", 8, 51.4, 17.4)]
    late = [(5, m(3), 1, "DEL", 1, 0.0, 0.0)]          # happened before event 3, arrives last
    src = tempfile.mkdtemp(prefix="platewise-test-stream-")
    for i, rows in enumerate((b1, b2, late)):
        _write(src, f"part-{i}.parquet", rows)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = {r.id: r.asDict() for r in streams.stream_locations(spark, stream, coords).collect()}
    allc = spark.createDataFrame(b1 + b2 + late, ", ".join(
        f"{c} {t}" for c, t in zip(CMD_COLS, ["long", "timestamp", "long", "string", "long", "double", "double"])))
    exp = {r.id: r.asDict() for r in moderation.moderate_locations(coords, allc).collect()}
    assert got == exp
    # DEL (late) then VER: the VER takes the cleared point, as in the sequential order
    assert (got[1]["lat"], got[1]["verified"]) == (0.0, True)


def test_stream_dedup_drops_second_delivery(spark):
    src = tempfile.mkdtemp(prefix="platewise-test-dedup-")
    rows = [(1, T0, 1, "VER", 1, 0.0, 0.0), (2, T0 + dt.timedelta(minutes=1), 1, "DEL", 1, 0.0, 0.0)]
    _write(src, "a.parquet", rows)
    _write(src, "b.parquet", rows[:1])                  # event 1 delivered again
    schema = spark.read.parquet(src).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .withColumn("ts", F.col("ts").cast("timestamp")))    # watermarks need TIMESTAMP
    got = sorted(r.event_id for r in streams.stream_dedup(spark, stream).collect())
    assert got == [1, 2]


def test_stream_dedup_keeps_late_first_deliveries(spark):
    src, out = tempfile.mkdtemp(prefix="platewise-test-dedup-"), tempfile.mkdtemp(prefix="platewise-test-out-")
    row = lambda i: (i, T0 + dt.timedelta(days=i), 1, "VER", 1, 0.0, 0.0)
    for i, ids in enumerate(([20, 29, 29], [3, 20, 11], [12, 3, 1, 29])):   # days, not in order of time
        _write(src, f"part-{i}.parquet", [row(x) for x in ids])
    schema = spark.read.parquet(src).schema

    def run():
        stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
                  .withColumn("ts", F.col("ts").cast("timestamp")))
        rows = streams.stream_dedup(spark, stream, out=out)
        assert rows.columns == CMD_COLS
        return sorted(r.event_id for r in rows.collect())

    assert run() == [1, 3, 11, 12, 20, 29]
    _write(src, "part-9.parquet", [row(2), row(11)])                        # arrives between two runs
    assert run() == [1, 2, 3, 11, 12, 20, 29]


def test_snapshot_versions(spark):
    from platewise.sources import snapshots
    root = os.path.join(tempfile.mkdtemp(prefix="platewise-test-snap-"), "t")
    assert snapshots.read_version(spark, root) is None
    v1 = snapshots.publish(spark.createDataFrame([(1, "a")], "id long, v string"), root)
    old = snapshots.read_version(spark, root)
    v2 = snapshots.publish(spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string"), root)
    assert (v1, v2) == (1, 2)
    assert sorted(tuple(r) for r in snapshots.read_version(spark, root).collect()) == [(1, "b"), (2, "c")]
    assert [tuple(r) for r in old.collect()] == [(1, "a")]          # readers of v1 are untouched
    snapshots.write_version(spark.createDataFrame([(9, "z")], "id long, v string"), root, 2)  # retry of v2
    assert [tuple(r) for r in snapshots.read_version(spark, root).collect()] == [(9, "z")]


def test_stream_flags_order_free_across_batches(spark):
    from tests.fixtures import catalog
    cat = catalog(spark)
    src = tempfile.mkdtemp(prefix="platewise-test-flags-")
    m = lambda i: T0 + dt.timedelta(minutes=i)
    rows = [(1, m(1), 2, "VER", 1, 0.0, 0.0), (2, m(2), 2, "DEL", 3, 0.0, 0.0),
            (3, m(3), 2, "VER", 2, 0.0, 0.0), (4, m(4), 3, "VER", 3, 0.0, 0.0)]
    for i, r in enumerate(reversed(rows)):            # newest first, one per micro-batch
        _write(src, f"f{i}.parquet", [r])
    schema = spark.read.parquet(src).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
              .select("event_id", "ts", "key", "action", "actor"))
    got = {r.id: (r.verified, r.deleted, r.verified_by)
           for r in streams.stream_flags(spark, stream, cat.users, cat.restaurants).collect()}
    batch = spark.createDataFrame([r[:5] for r in rows], "event_id long, ts timestamp, key long, action string, actor long")
    exp = {r.id: (r.verified, r.deleted, r.verified_by)
           for r in moderation.moderate_flags(cat.restaurants, batch, cat.users).collect()}
    assert got == exp
    assert got[2] == (True, True, 3) and got[3] == (True, False, 3)


def test_event_stream_reads_a_folder_of_part_files(spark):
    import shutil
    src = tempfile.mkdtemp(prefix="platewise-test-events-")
    table = pq.read_table("/root/testdata/sf0.001/events.parquet")
    os.mkdir(f"{src}/events.parquet")
    for i in range(4):
        part = table.slice(i * len(table) // 4, (i + 1) * len(table) // 4 - i * len(table) // 4)
        pq.write_table(part, f"{src}/events.parquet/part-{i}.parquet")
    out = tempfile.mkdtemp(prefix="platewise-test-out-")

    def run():
        streams._run(streams.event_stream(spark, src).writeStream.format("parquet")
                     .option("path", f"{out}/data").option("checkpointLocation", f"{out}/state"))
        return spark.read.parquet(f"{out}/data").count()

    assert run() == len(table)
    shutil.copy(f"{src}/events.parquet/part-0.parquet", f"{src}/events.parquet/part-9.parquet")
    assert run() == len(table) + pq.read_metadata(f"{src}/events.parquet/part-0.parquet").num_rows


def test_only_a_missing_folder_counts_as_no_snapshot(spark):
    import pytest
    from platewise.sources import snapshots
    root = tempfile.mkdtemp(prefix="platewise-test-snap-")
    assert snapshots.latest_version(spark, f"{root}/none") is None
    pq.write_table(pa.table({"x": [1]}), f"{root}/a.parquet")
    with pytest.raises(Exception):
        snapshots.latest_version(spark, root)
