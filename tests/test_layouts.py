"""Stored layouts: the gram index and the space-filling curve give the plain
answers and read a part of the files."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from platewise.functions import geo
from platewise.operators import gram_index
from platewise.sources import spatial


def folder():
    return tempfile.mkdtemp(prefix="platewise-test-layout-")


def size(paths):
    return sum(os.path.getsize(p.removeprefix("file:")) for p in paths)


def test_terms_against_every_name(spark):
    rnd = random.Random(9)
    syllables = ["ba", "Na", "ro", "É", "to", "x", " ", "lu", "ana", "na"]
    rows = [(i, "".join(rnd.choice(syllables) for _ in range(rnd.randint(0, 9)))) for i in range(800)] + [(900, None), (901, ""), (902, "banana"), (902, "banana")]
    terms = ["a", "NA", "ana", "nana", "banana", "anaana", "é", "x ", "zzz", "lutolu", "nanana", "", None, "ana"] + [n[1][2:7] for n in rows[:20]]
    path = folder()
    gram_index.write_index(spark.createDataFrame(rows, "id long, name string"), path)
    got = {tuple(r) for r in gram_index.search_terms(spark, path, spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {(t, i) for t in terms if t for i, n in rows if n is not None and t.lower() in n.lower()}
    wanted = spark.createDataFrame([("zzz",), ("lut",)], "gram string")
    read = gram_index.postings(spark, path, wanted)
    assert size(read.inputFiles()) < 0.1 * size(spark.read.parquet(path).inputFiles())
    empty = folder()
    gram_index.write_index(spark.createDataFrame([(1, None)], "id long, name string"), empty)


def test_a_box_reads_few_files_and_all_its_points(spark):
    rnd = random.Random(10)
    points = [(i, rnd.gauss(51, 2), rnd.gauss(17, 3)) for i in range(6000)] + [(9000, 90.0, 180.0), (9001, -90.0, -180.0), (9002, None, None), (9003, 0.0, 0.0)]
    path = folder()
    spatial.write_points(spark.createDataFrame(points, "id long, lat double, lon double"), path, folder_rows=200)
    whole = spark.read.parquet(path)
    assert whole.count() == len(points)
    total = len({f.rsplit("/", 1)[0] for f in whole.inputFiles()})
    assert total >= 16
    boxes = [geo.bounding_box(51.1, 17.03, 5.0), geo.bounding_box(50.0, 16.0, 60.0), (-90.0, 90.0, -180.0, 180.0), (80.0, 90.0, 170.0, 180.0), (-10.0, -9.0, 3.0, 4.0)]
    for south, north, west, east in boxes:
        read = spatial.read_box(spark, path, south, north, west, east)
        inside = {i for i, lat, lon in points if lat is not None and south <= lat <= north and west <= lon <= east}
        assert inside <= {r.id for r in read.collect()}
        assert read.columns == ["id", "lat", "lon"]
        assert len(spatial.ranges(south, north, west, east)) <= spatial.MOST_RANGES + 4
    near = spatial.read_box(spark, path, *boxes[0])
    assert len({f.rsplit("/", 1)[0] for f in near.inputFiles()}) <= total / 4
    assert near.count() < 200


def test_curve_places(spark):
    rows = [(0.0, 0.0), (51.1, 17.0), (-33.3, 151.2), (89.99, -179.99)]
    got = spark.createDataFrame(rows, "lat double, lon double").select(spatial.place(F.col("lat"), F.col("lon")).alias("z")).collect()
    for (lat, lon), r in zip(rows, got, strict=True):
        y, x = int((lat + 90) / 180 * 65536), int((lon + 180) / 360 * 65536)
        assert r.z == sum(((y >> b & 1) << (2 * b + 1)) | ((x >> b & 1) << (2 * b)) for b in range(16))
        a = spatial.ranges(lat, lat, lon, lon)
        assert any(first <= r.z <= last for first, last in a)
