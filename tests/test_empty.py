"""Operators on empty inputs: no crash, sensible (empty or unchanged) output."""

import datetime as dt

import pytest

from platewise.operators import geo_join, ingest, moderation, search
from platewise.operators.asof import carry_forward
from platewise.operators.ids import assign_ids
from tests.fixtures import catalog

CMD = "event_id long, ts timestamp, key long, action string, actor long"


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def test_empty_id_assignment_and_carry_forward(spark):
    df = spark.createDataFrame([], "k long")
    assert assign_ids(df, ["k"], start=10).count() == 0
    e = spark.createDataFrame([], "k long, t long, v long")
    assert carry_forward(e, "k", ["t"], "v", "c").count() == 0


def test_no_commands_leave_snapshots_unchanged(cat, spark):
    cmds = spark.createDataFrame([], CMD + ", p_lat double, p_lon double")
    before = sorted(tuple(r) for r in cat.coordinates.collect())
    assert sorted(tuple(r) for r in moderation.moderate_locations(cat.coordinates, cmds).collect()) == before
    flags = moderation.moderate_flags(cat.restaurants, spark.createDataFrame([], CMD), cat.users)
    assert sorted(tuple(r) for r in flags.select(*cat.restaurants.columns).collect()) == \
        sorted(tuple(r) for r in cat.restaurants.collect())
    props = spark.createDataFrame([], "event_id long, ts timestamp, key long, actor long, mon string, "
                                      "tue string, wed string, thu string, fri string, sat string, "
                                      "sun string, special_text string")
    h = moderation.moderate_hours(cat.hours, props, spark.createDataFrame([], CMD), cat.restaurants, cat.users)
    assert h.count() == cat.hours.count()


def test_empty_probe_set(cat, spark):
    p = spark.createDataFrame([], "probe_id long, lat double, lon double")
    t = cat.coordinates.select("id", "lat", "lon").withColumnRenamed("id", "res_id")
    assert geo_join.radius_join(p, t, 1.0).count() == 0


def test_search_without_matches(cat):
    assert search.search_by_dish(cat, "zzz").count() == 0
    assert search.advanced_search(cat, res_name="zzz", as_of=dt.datetime(2025, 1, 7, 12)).count() == 0


def test_empty_ingestion_batches(cat, spark):
    subs = spark.createDataFrame([], "sub_id long, actor long, name string, address string, cuisines array<string>")
    new, links, rej = ingest.ingest_venues(cat.restaurants, cat.cuisines, subs, cat.users)
    assert (new.count(), links.count(), rej.count()) == (0, 0, 0)
    regs = spark.createDataFrame([], "reg_id long, ts timestamp, login string, email string")
    assert ingest.validate_users(cat.users, regs).count() == 0
