"""Whole-file JSON arrays read by byte ranges."""

import json
import random
import tempfile

import pytest

from platewise.sources import files

SCHEMA = "id long, name string, more struct<note: string, tags: array<string>>"


def objects(n=120):
    rnd = random.Random(4)
    alphabet = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "中", " ", " ", "a", "\\\"", "}{"]
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12)))
    return [{"id": i, "name": word(), "more": {"note": word(), "tags": [word() for _ in range(rnd.randint(0, 3))]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("width", ["97", "1000", "128m"])
def test_byte_ranges_equal_the_whole_file(spark, indent, width):
    path = tempfile.mkdtemp(prefix="platewise-test-json-")
    first, second = objects(), objects(7)
    for name, rows in (("a.json", first), ("b.json", second), ("c.json", []), ("d.json", None)):
        with open(f"{path}/{name}", "w", encoding="utf-8") as f:
            f.write("" if rows is None else json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", width)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = files.read_json_arrays(spark, path, files.T.StructType.fromDDL(SCHEMA), whole_file=True)
        got = sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in read.collect()))
        tasks = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert got == sorted(json.dumps(r, sort_keys=True) for r in first + second)
    assert tasks > 50 if width == "97" else tasks >= 1


def test_written_files_read_back(spark):
    path = tempfile.mkdtemp(prefix="platewise-test-json-")
    rows = [(o["id"], o["name"], o["more"]["note"]) for o in objects(50)]
    df = spark.createDataFrame(rows, "id long, name string, note string").repartition(5)
    files.write_json_files(df, f"{path}/out")
    assert sorted(map(tuple, files.read_json_arrays(spark, f"{path}/out", df.schema, whole_file=True).collect())) == sorted(rows)
    files.write_json_files(df.limit(0), f"{path}/none")
    assert files.read_json_arrays(spark, f"{path}/none", df.schema, whole_file=True).count() == 0


def test_arrays_of_a_line_keep_order_and_size(spark):
    path = tempfile.mkdtemp(prefix="platewise-test-json-")
    df = spark.range(25).coalesce(1)
    files.write_json_arrays(df, f"{path}/out", rows_per_array=10)
    lines = [json.loads(r.value) for r in spark.read.text(f"{path}/out").collect()]
    assert [[o["id"] for o in line] for line in lines] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_points_of_both_byte_orders(spark):
    import struct

    little = struct.pack("<IBIdd", 0, 1, 1, 1.5, -2.5)
    big = struct.pack("<I", 0) + struct.pack(">BIdd", 0, 1, 1.5, -2.5)
    line = struct.pack("<IBIdd", 0, 1, 2, 1.5, -2.5)
    odd = struct.pack("<IBIdd", 0, 7, 1, 1.5, -2.5)
    df = spark.createDataFrame([(i, b) for i, b in enumerate([little, big, line, odd, little[:9], None])], "id int, b binary")
    got = [r.p and tuple(r.p) for r in df.select("id", files.decode_point("b").alias("p")).orderBy("id").collect()]
    assert got[:2] == [(1.5, -2.5)] * 2 and all(p is None or p == (None, None) for p in got[2:])
