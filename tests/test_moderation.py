"""Moderation folds against a plain-Python sequential fold (the reference's
one-UPDATE-at-a-time semantics) on fixtures and random logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from platewise.operators import moderation
from tests.fixtures import HOURS_SCHEMA, catalog

T0 = dt.datetime(2025, 1, 1)
LOC_SCHEMA = ("id long, verified boolean, lat double, lon double, pending_lat double, pending_lon double, "
              "updated_by long, verified_by long, edited_by long")
CMD_SCHEMA = "event_id long, ts timestamp, key long, action string, actor long, p_lat double, p_lon double"


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def fold_location(state, cmds):
    s = dict(state)
    for action, actor, plat, plon in cmds:
        if action == "UPDATE":
            s.update(pending_lat=plat, pending_lon=plon, verified=False, edited_by=actor)
        elif action == "DEL":
            s.update(pending_lat=0.0, pending_lon=0.0, verified=False, verified_by=actor, edited_by=0)
        elif action == "VER" and not s["verified"]:
            s.update(lat=s["pending_lat"], lon=s["pending_lon"], pending_lat=0.0, pending_lon=0.0,
                     verified=True, verified_by=actor, updated_by=s["edited_by"], edited_by=0)
    return s


def run_locations(spark, states, logs):
    snap = spark.createDataFrame([tuple(s[c] for c in ("id", "verified", "lat", "lon", "pending_lat", "pending_lon",
                                                       "updated_by", "verified_by", "edited_by"))
                                  for s in states], LOC_SCHEMA)
    rows, eid = [], 0
    for key, cmds in logs.items():
        for i, (action, actor, plat, plon) in enumerate(cmds):
            eid += 1
            rows.append((eid, T0 + dt.timedelta(minutes=i), key, action, actor, plat, plon))
    random.Random(7).shuffle(rows)    # arrival order must not matter
    cmds = spark.createDataFrame(rows, CMD_SCHEMA)
    return {r.id: r.asDict() for r in moderation.moderate_locations(snap, cmds).collect()}


def test_location_fixture_sequence(spark):
    start = dict(id=1, verified=True, lat=51.1, lon=17.03, pending_lat=51.2, pending_lon=17.1,
                 updated_by=9, verified_by=0, edited_by=0)
    log = [("VER", 1, 0.0, 0.0), ("UPDATE", 7, 51.3, 17.2), ("VER", 1, 0.0, 0.0), ("VER", 1, 0.0, 0.0),
           ("DEL", 1, 0.0, 0.0), ("VER", 1, 0.0, 0.0)]
    expected_after = {
        1: dict(verified=True, lat=51.1, pending_lat=51.2, edited_by=0),
        2: dict(verified=False, lat=51.1, pending_lat=51.3, edited_by=7),
        3: dict(verified=True, lat=51.3, pending_lat=0.0, verified_by=1, updated_by=7, edited_by=0),
        4: dict(verified=True, lat=51.3, pending_lat=0.0, updated_by=7),
        5: dict(verified=False, lat=51.3, pending_lat=0.0, verified_by=1, edited_by=0),
        6: dict(verified=True, lat=0.0, lon=0.0, updated_by=0),
    }
    states = [dict(start, id=n) for n in range(1, 7)]
    got = run_locations(spark, states, {n: log[:n] for n in range(1, 7)})
    for n, exp in expected_after.items():
        for k, v in exp.items():
            assert got[n][k] == v, (n, k)


def test_location_random_logs_match_sequential_fold(spark):
    rnd = random.Random(11)
    states, logs, expected = [], {}, {}
    for key in range(1, 301):
        st = dict(id=key, verified=rnd.random() < 0.5, lat=rnd.choice([0.0, 51.0 + key / 1000]),
                  lon=17.0, pending_lat=rnd.choice([0.0, 52.0]), pending_lon=rnd.choice([0.0, 18.0]),
                  updated_by=rnd.randint(0, 5), verified_by=rnd.randint(0, 5), edited_by=rnd.randint(0, 5))
        log = []
        for _ in range(rnd.randint(0, 9)):
            a = rnd.choice(["UPDATE", "VER", "VER", "DEL"])
            log.append((a, rnd.randint(1, 9), 50.0 + rnd.randint(1, 99) / 10, 16.0 + rnd.randint(1, 99) / 10))
        states.append(st)
        logs[key] = log
        expected[key] = fold_location(st, log)
    got = run_locations(spark, states, logs)
    for key, exp in expected.items():
        assert got[key] == exp, (key, logs[key])


def fold_hours(base, log):
    """Sequential fold of (event_id, action, actor, version or None); without a
    version VER/DEL address the newest one so far."""
    versions = {v["id"]: dict(v) for v in base}
    newest = max(versions, default=None)
    for eid, action, actor, version in log:
        if action == "INSERT":
            newest = eid + moderation.VERSION_ID_OFFSET
            versions[newest] = dict(id=newest, verified=False, deleted=False, verified_by=0)
            continue
        v = versions.get(version or newest)
        if v is not None and action == "VER" and not v["deleted"]:
            v.update(verified=True, verified_by=actor)
            for w in versions.values():
                if w["id"] != v["id"]:
                    w["deleted"] = True
        elif v is not None and action == "DEL" and not v["verified"]:
            v.update(deleted=True, verified_by=actor)
    return versions


def random_hours_logs(spark, by_id):
    """Snapshot, proposals, commands, users, venues and the expected fate of every version."""
    rnd = random.Random(5 + by_id)
    base_rows, props, mods, expected = [], [], [], {}
    eid = 0
    for key in range(1, 301):
        ids = [key + 1000 * n for n in range(rnd.randint(0, 3))]
        base = [dict(id=i, verified=rnd.random() < 0.4, deleted=rnd.random() < 0.3, verified_by=0) for i in ids]
        log = []
        for _ in range(rnd.randint(0, 14)):
            eid += 1
            a = rnd.choice(["INSERT", "VER", "DEL", "VER", "INSERT"])
            actor = rnd.randint(1, 4)
            ts = T0 + dt.timedelta(minutes=eid)
            version = None
            if a == "INSERT":
                ids.append(eid + moderation.VERSION_ID_OFFSET)
                props.append((eid, ts, key, actor))
            else:
                # also ids that nobody has, and ids of versions that come later
                version = rnd.choice(ids[-3:] + ids[:1] + [eid + 1 + moderation.VERSION_ID_OFFSET]) if by_id else None
                mods.append((eid, ts, version if by_id else key, a, actor))
            log.append((eid, a, actor, version))
        base_rows += [(b["id"], key, *(["closed"] * 7), None, 0, b["verified_by"], b["verified"], b["deleted"])
                      for b in base]
        for v in fold_hours(base, log).values():
            expected[v["id"]] = (v["verified"], v["deleted"], v["verified_by"])
    p = spark.createDataFrame(props, "event_id long, ts timestamp, key long, actor long").select(
        "*", *[F.lit("closed").alias(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")],
        F.lit("{}").alias("special_text"))
    m = spark.createDataFrame(mods, f"event_id long, ts timestamp, {'version' if by_id else 'key'} long, action string, actor long")
    users = spark.createDataFrame([(i, True) for i in range(1, 5)], "id long, is_admin boolean")
    venues = spark.createDataFrame([(k,) for k in range(1, 301)], "id long")
    return spark.createDataFrame(base_rows, HOURS_SCHEMA), p, m, venues, users, expected


@pytest.mark.parametrize("by_id", [False, True])
def test_hours_random_logs_match_sequential_fold(spark, by_id):
    fold = moderation.moderate_hours_by_id if by_id else moderation.moderate_hours
    hours, p, m, venues, users, expected = random_hours_logs(spark, by_id)
    state = lambda df: {r.id: (r.verified, r.deleted, r.verified_by) for r in df.collect()}
    assert state(fold(hours, p, m, venues, users)) == expected
    # the log in two parts
    mid = F.lit(T0 + dt.timedelta(minutes=m.count() * 5 // 6))
    first = fold(hours, p.where(F.col("ts") < mid), m.where(F.col("ts") < mid), venues, users)
    second = fold(first, p.where(F.col("ts") >= mid), m.where(F.col("ts") >= mid), venues, users)
    assert state(second) == expected


def test_hours_long_chain(spark):
    """Every version is verified in turn, one of them many times."""
    n = 300
    p = spark.range(n).select((F.col("id") * 3 + 1).alias("event_id"), F.lit(1).cast("long").alias("key"), F.lit(1).cast("long").alias("actor"),
                              *[F.lit("closed").alias(d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")],
                              F.lit("{}").alias("special_text"))
    m = spark.range(2 * n).select((F.col("id") + F.floor(F.col("id") / 2) + 2).alias("event_id"), F.lit("VER").alias("action"),
                                  F.lit(1).cast("long").alias("actor"))
    m = m.withColumn("version", F.expr(f"event_id - (event_id - 1) % 3 + {moderation.VERSION_ID_OFFSET}"))
    at = F.timestamp_seconds("event_id")
    users, venues = spark.createDataFrame([(1, True)], "id long, is_admin boolean"), spark.createDataFrame([(1,)], "id long")
    out = moderation.moderate_hours_by_id(spark.createDataFrame([], HOURS_SCHEMA), p.withColumn("ts", at), m.withColumn("ts", at), venues, users)
    assert [(r.n, r.v, r.live) for r in out.selectExpr("count(*) n", "count_if(verified) v", "count_if(not deleted) live").collect()] == [(n, n, 1)]


def test_flags_order_free_and_gated(cat, spark):
    rows = [(1, T0, 2, "VER", 1), (2, T0 + dt.timedelta(minutes=1), 2, "DEL", 3),
            (3, T0 + dt.timedelta(minutes=2), 2, "VER", 2)]   # user 2 is not an admin
    for perm in ([0, 1, 2], [2, 1, 0], [1, 2, 0]):
        cmds = spark.createDataFrame([rows[i] for i in perm],
                                     "event_id long, ts timestamp, key long, action string, actor long")
        r = {x.id: x for x in moderation.moderate_flags(cat.restaurants, cmds, cat.users).collect()}[2]
        assert (r.verified, r.deleted, r.verified_by) == (True, True, 3)


def test_menu_moderation_changes_all_duplicates(cat, spark):
    cmds = spark.createDataFrame([(1, T0, 2, 10, "VER", 1)],
                                 "event_id long, ts timestamp, id_restaurant long, id_dish long, action string, actor long")
    new_menu, _ = moderation.moderate_menu(cat, cmds)
    got = [r.verified for r in new_menu.where("id_restaurant = 2 AND id_dish = 10").collect()]
    assert got == [True, True]


def test_diet_flags(cat):
    got = {r.id: (r.vegan, r.vegetarian) for r in moderation.derive_diet_flags(cat).collect()}
    assert got == {10: (False, True), 11: (False, False), 12: (True, True), 13: (True, True)}


def test_role_gate(cat, spark):
    cmds = spark.createDataFrame([(1, "VER", 1), (2, "VER", 2), (3, "UPDATE", 2), (4, "UPDATE", 99)],
                                 "event_id long, action string, actor long")
    got = sorted(r.event_id for r in moderation.role_gate(cmds, cat.users).collect())
    assert got == [1, 3]


@pytest.mark.parametrize("by_id", [False, True])
def test_hours_commands_delivered_twice_count_once(spark, by_id):
    fold = moderation.moderate_hours_by_id if by_id else moderation.moderate_hours
    hours, p, m, venues, users, expected = random_hours_logs(spark, by_id)
    out = fold(hours, p.union(p), m.union(m), venues, users)
    assert {r.id: (r.verified, r.deleted, r.verified_by) for r in out.collect()} == expected


def test_successors_in_a_circle_are_an_error(spark):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next long")
    with pytest.raises(ValueError):
        moderation._reached(spark.createDataFrame([(1,)], "node long"), circle)
