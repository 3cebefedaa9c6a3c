"""Tasks take bounded work, whatever files and shuffle settings would make of it."""

import math
import random

from pyspark.sql import functions as F

from platewise.operators import geo_join, salted, views


def test_pairs_of_crowded_cells_are_dealt(spark, monkeypatch):
    """Few rows in one file make many pairs: they go to several tasks, with the plain distances."""
    monkeypatch.setattr(geo_join, "TASK_PAIRS", 1000, raising=False)
    rng = random.Random(3)
    at = lambda: (51.05 + rng.random() * 0.02, 16.92 + rng.random() * 0.03)
    probes, targets = [(i, *at()) for i in range(200)], [(i, *at()) for i in range(150)] + [(150, None, 17.0)]
    probes += [(200, *targets[0][1:]), (201, 51.05, None)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, lat double, lon double").coalesce(1)
    join = lambda: geo_join.radius_join(frame(probes, "probe_id"), frame(targets, "res_id"), 0.5)
    got = join()

    def km(a, b):
        (x, y), (u, v) = map(math.radians, a), map(math.radians, b)
        return 6371.0 * math.acos(max(-1, min(1, math.cos(x) * math.cos(u) * math.cos(v - y) + math.sin(x) * math.sin(u))))

    want = {(i, j): km(a, b) for i, *a in probes for j, *b in targets if None not in (*a, *b)}
    want = {k: d for k, d in want.items() if d <= 0.5}
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r.distance_km - want[r.probe_id, r.res_id]) < 6e-7 for r in rows)
    assert got.groupBy(F.spark_partition_id()).count().count() > 4
    monkeypatch.setattr(geo_join, "FEW_TARGETS", 10)
    assert sorted(join().collect()) == sorted(rows)
    assert join().groupBy(F.spark_partition_id()).count().count() > 4


def test_six_places_as_round(spark):
    rng = random.Random(4)
    values = [0.0, 0.5, 1e-7, 5e-7, 0.0000015, 0.1234565, 0.2500005, 20015.0868015] + [k * 5e-7 for k in range(1, 2000)] + [rng.random() * 20000 for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "d double").select(F.round("d", 6).alias("a"), geo_join._six_places(F.col("d")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """The tasks of a salted join and of its sort grow in number with the rows."""
    monkeypatch.setattr(salted, "TASK_ROWS", 500, raising=False)
    rows = spark.range(6000).select((F.col("id") % 400).alias("id_dish"), F.floor(F.col("id") / 600).alias("v"))
    heavy = rows.union(spark.range(2000).select(F.lit(7).cast("long"), F.col("id") % 900)).coalesce(1)
    names = spark.range(400).select(F.col("id").alias("id_dish"), F.concat(F.lit("n"), "id").alias("name"))
    joined = salted.salted_join(heavy, names, "id_dish")
    assert sorted(joined.collect()) == sorted(heavy.join(names, "id_dish").select(joined.columns).collect())
    assert joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
    ordered = views.in_order(joined, 8000, "id_dish", "v")
    assert ordered.collect() == sorted(ordered.collect(), key=lambda r: (r.id_dish, r.v))
