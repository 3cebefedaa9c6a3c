"""Tables kept under a stream: same answers as in one piece, in any order of
arrival, after killed epochs, and at a cost that follows the batch."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.operators import moderation
from platewise.streaming import commands as streams
from platewise.streaming import keyed
from tests.test_moderation import random_hours_logs
from tests.test_streams import LOC_SCHEMA, T0

CMDS = "event_id long, ts timestamp, key long, action string, actor long, p_lat double, p_lon double"


def folder():
    return tempfile.mkdtemp(prefix="platewise-test-keyed-")


def locations(keys=12):
    return [(k, k % 2 == 0, 50.0 + k, 17.0, 50.5, 17.5 if k % 3 else 0.0, 3, 0, 4) for k in range(1, keys + 1)]


def commands(n, keys=12, seed=1):
    rnd = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=i // 2), rnd.randint(1, keys + 1), rnd.choice(["UPDATE", "VER", "DEL", "VER"]),
             rnd.randint(1, 9), float(rnd.randint(0, 9)), 1.0) for i in range(n)]


def test_fold_in_any_order_equals_the_whole_log(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 20)      # buckets double on the way
    monkeypatch.setattr(keyed, "LOG_RUNS", 2)          # runs merge on the way
    state, log = spark.createDataFrame(locations(), LOC_SCHEMA), commands(120)
    want = sorted(map(tuple, moderation.moderate_locations(state, spark.createDataFrame(log, CMDS)).collect()))
    mixed = random.Random(2).sample(log, len(log))
    path = folder()
    kept = keyed.KeyedFold(spark, path, state, "id", spark.createDataFrame([], CMDS).schema, moderation.moderate_locations)
    assert sorted(map(tuple, kept.current().collect())) == sorted(locations())
    for epoch in range(8):
        batch = mixed[epoch * 15:(epoch + 1) * 15] + mixed[:2] + [(9999, None, 1, "DEL", 1, 0.0, 0.0)]     # repeats, and one without a time
        kept.apply(spark.createDataFrame(batch, CMDS), epoch)
        if epoch == 4:                                  # the epoch comes again, as after a crash before its end
            again = keyed.KeyedFold(spark, path, state, "id", kept.log_schema, moderation.moderate_locations)
            again.apply(spark.createDataFrame(batch, CMDS), epoch)
    assert sorted(map(tuple, kept.current().collect())) == want
    parts = kept.manifests.before()
    assert len({p["bucket"] for p in parts}) > 1
    assert len(kept.manifests.epochs()) == 9


def test_commands_in_order_are_read_a_bounded_number_of_times(spark):
    log, epochs = commands(60), 12
    kept = keyed.KeyedFold(spark, folder(), spark.createDataFrame(locations(), LOC_SCHEMA), "id",
                           spark.createDataFrame([], CMDS).schema, moderation.moderate_locations)
    for epoch in range(epochs):
        kept.apply(spark.createDataFrame(log[epoch * 5:(epoch + 1) * 5], CMDS), epoch)
    # once each, and again when runs merge: log2 of the epochs at most
    assert len(log) <= kept.read_rows <= 3 * len(log)
    newest = [p for p in kept.manifests.before() if p["kind"] == "state"]
    assert len(newest) <= 2 * epochs.bit_length() + 1   # bases are thinned out
    states = os.listdir(f"{kept.path}/state")
    assert sum(bool(os.listdir(f"{kept.path}/state/{s}")) for s in states) <= epochs + 1


def test_index_finds_exactly_the_ids_and_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 50)
    monkeypatch.setattr(keyed, "PAGE_IDS", 100)
    schema = T.StructType.fromDDL("id long, word string")
    index = keyed.IdIndex(spark, folder(), ["id"], schema)
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id long")
    assert index.lookup(ids([1]), 0).count() == 0
    for epoch in range(9):
        rows = [(i, f"w{i}") for i in range(epoch * 100, epoch * 100 + 100)] + [(epoch * 100, "twice")]
        index.add(spark.createDataFrame(rows, schema), epoch)
        if epoch == 5:
            index.add(spark.createDataFrame(rows, schema), epoch)      # run again
    runs = index.manifests.before()
    assert len(runs) <= 5 and max(r["bits"] for r in runs) >= 3
    found = sorted(map(tuple, index.lookup(ids([0, 250, 899, 900, -5]), 9).collect()))
    assert found == [(0, "twice"), (0, "w0"), (250, "w250"), (899, "w899")]
    assert len(index.buckets(ids([250]), 9)) <= 2 and len(index.buckets(ids(range(5000, 5050)), 9)) <= 5
    assert index.lookup(ids([899]), 8).count() == 0                    # not there before that epoch
    assert index.rows().count() == 909


def test_index_keeps_the_newest_row_of_an_id(spark):
    schema = T.StructType.fromDDL("id long, word string, at int")
    index = keyed.IdIndex(spark, folder(), ["id"], schema, newest="at")
    for epoch, rows in enumerate([[(1, "a", 1), (2, "b", 5)], [(1, "c", 3)], [(2, "d", 4)], [(1, "e", 2)]]):
        index.add(spark.createDataFrame(rows, schema), epoch)
    assert sorted(map(tuple, index.rows().collect())) == [(1, "c", 3), (2, "b", 5)]


def write_parts(spark, rows, schema, parts, seed=3):
    """Rows dealt over part files in no order, some of them twice."""
    rnd, path = random.Random(seed), folder()
    rows = rnd.sample(rows, len(rows)) + rnd.sample(rows, len(rows) // 5)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_hours_from_shuffled_parts(spark):
    hours, p, m, venues, users, expected = random_hours_logs(spark, True)
    both = p.unionByName(m, allowMissingColumns=True)
    stream = write_parts(spark, both.collect(), both.schema, 6)
    out = streams.stream_hours(spark, stream, hours, venues, users)
    assert {r.id: (r.verified, r.deleted, r.verified_by) for r in out.collect()} == expected


def submissions(seed=4):
    rnd = random.Random(seed)
    return [(i, T0 + dt.timedelta(minutes=i), rnd.randint(1, 8), rnd.randint(1, 6), float(rnd.randint(1, 5)), rnd.choice(["fine", "good", "bad!"]))
            for i in range(90)]


SUBS = "event_id long, ts timestamp, res_id long, actor long, score double, text string"


def upsert_tables(spark):
    return (spark.createDataFrame([(70, 1), (80, 2), (81, 1)], "id long, updated_by long"),
            spark.createDataFrame([(70, 1), (80, 2), (81, 1)], "id_comment long, id_restaurant long"),
            spark.createDataFrame([(i,) for i in range(1, 8)], "id long"), spark.createDataFrame([(i, False) for i in range(1, 6)], "id long, is_admin boolean"))


def test_upserts_from_shuffled_parts_and_a_repeated_epoch(spark):
    tables = upsert_tables(spark)
    subs = spark.createDataFrame(submissions(), SUBS)
    want = moderation.upsert_comments(*tables[:2], subs, *tables[2:])
    stream = write_parts(spark, subs.collect(), subs.schema, 5)
    out = folder()
    got = streams.stream_upsert_comments(spark, stream, *tables, out=out)
    plain = lambda df: sorted(map(tuple, df.drop("id").collect()))
    assert plain(got) == plain(want)
    old, new = got.where("not is_new"), got.where("is_new")
    assert sorted(r.id for r in old.collect()) == sorted(r.id for r in want.where("not is_new").collect())
    ids = sorted(r.id for r in new.collect())
    assert ids == list(range(82, 82 + len(ids)))                       # contiguous over epochs
    before = sorted(map(tuple, got.collect()))
    # the last epoch is lost and comes again: same ids
    last = max(int(f.split(".")[0]) for f in os.listdir(f"{out}/_checkpoint/commits") if not f.startswith("."))
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{out}/_checkpoint/commits/{name}")
    again = streams.stream_upsert_comments(spark, stream, *tables, out=out)
    assert sorted(map(tuple, again.collect())) == before


def test_dedup_reads_only_buckets_that_may_hold_the_ids(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKET_ROWS", 100)
    rows = [(i, T0, 1, "VER", 1, 0.0, 0.0) for i in range(1000)]
    stream = write_parts(spark, rows, spark.createDataFrame([], CMDS).schema, 5)
    out = folder()
    assert sorted(r.event_id for r in streams.stream_dedup(spark, stream, out=out).collect()) == list(range(1000))
    index = keyed.IdIndex(spark, f"{out}/ids", ["event_id"], T.StructType.fromDDL("event_id long"))
    assert sum(r["rows"] for r in index.manifests.before()) == 1000
    held = sum(1 << r["bits"] for r in index.manifests.before())
    assert len(index.buckets(spark.createDataFrame([(5000 + i,) for i in range(10)], "event_id long"), 99)) < held / 2


def test_dedup_keeps_rows_without_id(spark):
    rows = [(None, T0, 1, "VER", 1, 0.0, 0.0), (None, T0, 1, "VER", 1, 0.0, 0.0), (3, T0, 1, "VER", 1, 0.0, 0.0)]
    stream = write_parts(spark, rows, spark.createDataFrame([], CMDS).schema, 2)
    assert sorted(str(r.event_id) for r in streams.stream_dedup(spark, stream).collect()) == ["3", "None", "None"]


def test_flag_epochs_write_only_changed_keys(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), i, "VER", 1, 0.0, 0.0) for i in range(1, 7)]
    path, out = folder(), folder()
    schema = spark.createDataFrame([], CMDS).schema
    snapshot = spark.createDataFrame([(i, False, False, 0) for i in range(1, 8)], "id long, verified boolean, deleted boolean, verified_by long")
    users = spark.createDataFrame([(1, True)], "id long, is_admin boolean")
    for i in range(3):
        spark.createDataFrame(rows[2 * i:2 * i + 2], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path).select("event_id", "ts", "key", "action", "actor")
        got = streams.stream_flags(spark, stream, users, snapshot, out=out)
    assert sorted(r.id for r in got.where("verified").collect()) == [1, 2, 3, 4, 5, 6]
    written = spark.read.parquet(f"{out}/changes").groupBy("version").count().collect()
    assert sorted(r["count"] for r in written) == [2, 2, 2]


def test_diet_flags_follow_the_stream(spark):
    from tests.fixtures import catalog
    cat = catalog(spark)
    menu = cat.menu.select("id_restaurant", "id_dish").distinct().orderBy("id_restaurant", "id_dish").collect()
    rows = [(i, T0 + dt.timedelta(minutes=i), m.id_restaurant, m.id_dish, ("VER", "DEL")[i % 3 == 2], 1) for i, m in enumerate(menu)]
    schema = "event_id long, ts timestamp, id_restaurant long, id_dish long, action string, actor long"
    batch = spark.createDataFrame(rows, schema)
    _, want = moderation.moderate_menu(cat, batch)
    stream = write_parts(spark, rows, batch.schema, 3)
    got = streams.stream_diet_flags(spark, cat, stream)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
