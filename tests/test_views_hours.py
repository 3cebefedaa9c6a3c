import datetime as dt

import pytest
from pyspark.sql import functions as F

from platewise.functions.hours import valid_weekly_value
from platewise.operators import calendar, views
from platewise.operators.calendar import validate_special
from tests.fixtures import catalog


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def test_dishes_info_repeats_ingredients_per_menu_row(cat):
    got = {(r.id, r.res_id): r.ingredient_names for r in views.dishes_info(cat).collect()}
    assert got == {(10, 1): "Cheese,Lettuce", (10, 2): "Cheese,Cheese,Lettuce,Lettuce",
                   (10, 3): "Cheese,Lettuce", (11, 4): "Beef", (11, 5): "Beef",
                   (12, 1): "Lettuce,Lettuce"}


def test_ingredients_list_none_and_repeats(cat):
    got = {(r.id, r.dish_id): r.allergens_list for r in views.ingredients_list(cat).collect()}
    assert got == {(100, 10): "None", (100, 12): "None", (101, 10): "Lactose, Milk, Milk",
                   (102, 11): "None"}


def test_venue_details_and_lookup(cat, spark):
    req = spark.createDataFrame([(1,), (1,), (0,), (-3,), (4,)], "id long")
    got = {r.res_id: (r.res_cuisines, r.up_by) for r in views.venue_info(cat, req).collect()}
    assert got == {1: ("Thai,Vegan", "admin")}   # 4 has no cuisine; 0 and -3 are not ids


def test_comments_for_venue(cat, spark):
    req = spark.createDataFrame([(1,)], "id long")
    got = [(r.id, r.up_by, r.res_id) for r in views.venue_comments(cat, req).collect()]
    assert got == [(1, "seven", 1)]


def test_weekly_calendar(cat):
    cal = calendar.weekly_calendar(cat.restaurants, cat.hours, dt.date(2025, 1, 6), 3)
    got = {(r.res_id, r.day): r.hours for r in cal.collect()}
    assert [got[(1, d)] for d in ("06.01.2025", "07.01.2025", "08.01.2025")] == \
        ["closed", "10:00-12:00", "08:00-18:00"]
    assert [got[(2, d)] for d in ("06.01.2025", "07.01.2025", "08.01.2025")] == ["No data"] * 3
    assert [got[(5, d)] for d in ("06.01.2025", "07.01.2025", "08.01.2025")] == ["08:00-12:00"] * 3


@pytest.mark.parametrize("at,expected", [
    (dt.datetime(2025, 1, 7, 12, 0, 0), {1, 4, 5}),
    (dt.datetime(2025, 1, 7, 12, 0, 1), set()),
    (dt.datetime(2025, 1, 6, 9, 0, 0), {4, 5}),
])
def test_open_now(cat, at, expected):
    got = {r.res_id for r in calendar.open_now(cat.restaurants, cat.hours, at).collect()}
    assert got == expected


def test_overnight(spark):
    from tests.fixtures import HOURS_SCHEMA, hours_row
    h = spark.createDataFrame([hours_row(1, 1, "22:00-02:00", "x", "x", None, True, False)], HOURS_SCHEMA)
    r = spark.createDataFrame([(1, "Night")], "id long, name string")
    at = dt.datetime(2025, 1, 7, 23, 0)
    assert calendar.open_now(r, h, at).count() == 0
    assert calendar.open_now(r, h, at, overnight=True).count() == 1
    assert calendar.open_now(r, h, dt.datetime(2025, 1, 7, 1, 0), overnight=True).count() == 1
    assert calendar.open_now(r, h, dt.datetime(2025, 1, 7, 3, 0), overnight=True).count() == 0
    # Monday 01:00: Sunday ('x') had no overnight range, Monday's opens at 22:00
    assert calendar.open_now(r, h, dt.datetime(2025, 1, 6, 1, 0), overnight=True).count() == 0


def test_weekly_value_validation(spark):
    df = spark.createDataFrame([("08:00-18:00",), ("closed",), ("99:99-00:00",), ("8:00-18:00",), ("",),
                                (None,), ("08:00-18:00\n",)], "v string")
    got = [r.ok for r in df.select(valid_weekly_value(F.col("v")).alias("ok")).collect()]
    assert got == [True, True, True, False, False, False, False]


def test_special_validation(spark):
    df = spark.createDataFrame([({},), ({"24.06.2025": "closed"},), ({"2025-06-24": "closed"},),
                                ({"24.06.2025": "noon"},)], "special map<string,string>")
    got = [(r.special_valid, r.special_problem) for r in validate_special(df).collect()]
    assert got == [(True, None), (True, None),
                   (False, "bad_date:2025-06-24"),
                   (False, "bad_range:24.06.2025: noon")]


def test_nested_dish_report(cat):
    from platewise.operators import reports
    got = {(r.res_id, r.dish_id): [(e.ing_id, e.ing_name, e.allergens_names) for e in r.ing]
           for r in reports.user_dishes(cat, user=1).collect()}
    # only dish 10 has an ingredient with allergens (Cheese); Lettuce has none and is dropped
    assert got[(1, 10)] == [(101, "Cheese", "Lactose,Milk")]
    assert got[(1, 12)] == []
    kept = {(r.res_id, r.dish_id): [e.ing_name for e in r.ing]
            for r in reports.user_dishes(cat, user=1, keep_unlisted=True).collect()}
    assert kept[(1, 10)] == ["Lettuce", "Cheese"] or kept[(1, 10)] == ["Cheese", "Lettuce"]
    assert kept[(1, 12)] == ["Lettuce"]


def test_queue_and_user_reports(cat):
    from platewise.operators import reports
    assert [r.res_id for r in reports.queue_venues(cat).collect()] == [3]
    assert sorted((r.res_id, r.dish_id) for r in reports.queue_dishes(cat).collect()) == [(2, 10), (5, 13)]
    assert [r.c_id for r in reports.user_comments(cat, user=7).collect()] == [1]
    assert [r.hours_id for r in reports.queue_hours(cat).collect()] == [2]


def test_rows_as_json(cat):
    from platewise.sources.files import rows_as_json
    got = [r.json for r in rows_as_json(cat.cuisines.orderBy("id")).collect()]
    assert got[0] == '{"id":1,"type":"Thai"}'


def test_weekday_name_and_date_key(spark):
    from platewise.functions.hours import date_key, weekday_name
    df = spark.createDataFrame([(dt.date(2025, 1, 5) + dt.timedelta(days=i),) for i in range(7)], "d date")
    got = [(r.k, r.w) for r in df.orderBy("d").select(date_key(F.col("d")).alias("k"),
                                                      weekday_name(F.col("d")).alias("w")).collect()]
    assert [w for _, w in got] == ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]   # 5 Jan 2025 is a Sunday
    assert got[0][0] == "05.01.2025"


def test_json_array_sources_and_sink(spark, tmp_path):
    import json
    from pyspark.sql import types as T
    from platewise.sources.files import read_json_arrays, write_json_arrays
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "dishes.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}], indent=4))
    got = sorted(tuple(r) for r in read_json_arrays(spark, str(whole), schema, whole_file=True).collect())
    assert got == [(1, "a"), (2, "b")]
    df = spark.createDataFrame([(i, f"n{i}") for i in range(1000)], schema)
    out = str(tmp_path / "arrays")
    write_json_arrays(df, out, rows_per_array=64)
    lines = [x.value for x in spark.read.text(out).collect()]
    assert all(x.startswith("[") and len(json.loads(x)) <= 64 for x in lines)
    assert sorted(tuple(r) for r in read_json_arrays(spark, out, schema).collect()) == \
        [(i, f"n{i}") for i in range(1000)]
