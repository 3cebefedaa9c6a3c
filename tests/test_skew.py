"""A hot venue (a third of all menu rows) and a hot dish: with broadcasts off
and low skew thresholds AQE must split the skewed sort-merge join
partitions, and the answers must not change."""

import random
from collections import Counter, defaultdict

import pytest

from platewise.catalog import Catalog
from platewise.operators import search

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def skewed_catalog(spark, n_menu=30000):
    rnd = random.Random(3)
    venues = list(range(1, 401))
    dishes = list(range(1, 301))
    menu = []
    for _ in range(n_menu):
        v = 1 if rnd.random() < 1 / 3 else rnd.choice(venues)          # hot venue 1
        d = 7 if rnd.random() < 0.3 else rnd.choice(dishes)              # hot dish 7
        menu.append((v, d, rnd.random() < 0.8, 0, 0, False))
    c = spark.createDataFrame
    cat = Catalog(
        restaurants=c([(v, f"venue{v}", 0.0, True, "a", 0, 0, False) for v in venues],
                      "id long, name string, opinion double, verified boolean, address string, "
                      "updated_by long, verified_by long, deleted boolean"),
        cuisines=c([(i, f"c{i}") for i in range(1, 6)], "id long, type string"),
        restaurant_cuisines=c([(v, 1 + (v + j) % 5) for v in venues for j in range(1 + v % 3)],
                              "id_restaurant long, id_cuisine long"),
        dishes=c([(d, f"{'red' if d % 4 == 3 else 'blue'} dish{d}", 1, 1.0, 1.0, True, True) for d in dishes],
                 "id long, name string, calories int, price double, weight double, vegetarian boolean, vegan boolean"),
        menu=c(menu, "id_restaurant long, id_dish long, verified boolean, updated_by long, "
                     "verified_by long, deleted boolean"),
        ingredients=None, dish_ingredients=None, allergens=None, ingredient_allergens=None,
        coordinates=None, hours=None, comments=None, restaurant_comments=None, users=None)
    return cat, menu


def expected_dish_search(menu, venues_tags, dish_names, term):
    n, names = Counter(), defaultdict(set)
    for v, d, verified, *_ in menu:
        if verified and term in dish_names[d]:
            n[v] += 1
            names[v].add(dish_names[d])
    return {v: (n[v] * len(venues_tags[v]), ",".join(sorted(names[v]))) for v in n if venues_tags.get(v)}


def test_skewed_dish_search(skew_session):
    spark = skew_session
    cat, menu = skewed_catalog(spark)
    df = search.search_by_dish(cat, "red")
    got = {r.res_id: (r.sort_score, r.dish_names) for r in df.collect()}
    tags = defaultdict(list)
    for r in cat.restaurant_cuisines.collect():
        tags[r.id_restaurant].append(r.id_cuisine)
    names = {r.id: r.name for r in cat.dishes.collect()}
    assert got == expected_dish_search(menu, tags, names, "red")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the hot dish partition of the menu side is split (Spark 4 prints "skew=true")
    assert "SortMergeJoin(skew=true)" in plan and "AQEShuffleRead skewed" in plan, plan


def test_a_venue_with_a_third_of_the_log_is_split(spark):
    """W8: slices of a log cut hot venues; the answer equals the sequential rules on every venue."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from platewise.operators import asof, moderation
    from tests.test_moderation import fold_location

    rnd = random.Random(8)
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i), 1 if i % 3 == 0 else rnd.randint(2, 400), rnd.choice(["UPDATE", "VER", "DEL", "VER"]),
             rnd.randint(1, 9), float(rnd.randint(1, 9)), 2.0) for i in range(30_000)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, key long, action string, actor long, p_lat double, p_lon double")
    seen = asof.previous(log, "key", ["ts", "event_id"], "event_id", "before", num_partitions=16)
    before, expected = {}, {}
    for i, _, key, *_ in rows:
        expected[i] = before.get(key)
        before[key] = i
    assert {r.event_id: r.before for r in seen.select("event_id", "before").collect()} == expected
    slices = log.repartitionByRange(16, "key", "ts", "event_id").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in slices)
    assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    states = {k: dict(id=k, verified=k % 2 == 0, lat=50.0, lon=17.0, pending_lat=51.0, pending_lon=18.0, updated_by=3, verified_by=0, edited_by=4)
              for k in range(1, 400)}
    schema = ("id long, verified boolean, lat double, lon double, pending_lat double, pending_lon double, "
              "updated_by long, verified_by long, edited_by long")
    got = {r.id: r.asDict() for r in moderation.moderate_locations(spark.createDataFrame([tuple(s.values()) for s in states.values()], schema), log).collect()}
    logs = {}
    for event in rows:
        logs.setdefault(event[2], []).append(event[3:])
    for key in (1, 2, 3, 77, 399):
        assert got[key] == fold_location(states[key], logs.get(key, []))


def full_skewed_catalog(spark):
    cat, menu = skewed_catalog(spark, 12000)
    c = spark.createDataFrame
    return cat.with_tables(
        ingredients=c([(i, f"ing{i}", i % 2 == 0, i % 3 == 0) for i in range(1, 41)], "id long, name string, vegetarian boolean, vegan boolean"),
        dish_ingredients=c([(1 + (d * 7 + j) % 40, d) for d in range(1, 301) for j in range(d % 4)], "id_ingredient long, id_dish long"),
        allergens=c([(i, f"alg{i}") for i in range(1, 6)], "id long, name string"),
        ingredient_allergens=c([(1 + i % 5, i) for i in range(1, 41) if i % 4], "id_allergen long, id_ingredient long"))


def test_hot_keys_are_found_and_split(skew_session):
    from pyspark.sql import functions as F

    from platewise.operators import salted

    spark = skew_session
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        cat, menu = skewed_catalog(spark)
        rows = cat.menu.withColumn("n", F.monotonically_increasing_id()).union(spark.createDataFrame(
            [(None, None, True, 0, 0, False, -1)], "id_restaurant long, id_dish long, verified boolean, updated_by long, verified_by long, deleted boolean, n long"))
        assert salted.heavy_keys(rows, "id_dish") == [7] and salted.heavy_keys(rows, "id_restaurant") == [1]
        assert salted.heavy_keys(rows.limit(0), "id_dish") == []
        names = cat.dishes.select(F.col("id").alias("id_dish"), "name").where("id_dish <> 9")
        for how in ("inner", "left"):
            got, want = salted.salted_join(rows, names, "id_dish", how), rows.join(names, "id_dish", how)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        shares = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        plain, split = shares(rows.join(names, "id_dish")), shares(salted.salted_join(rows, names, "id_dish"))
        assert max(split) < max(plain) and max(split) <= 2 * split[len(split) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")


@pytest.mark.parametrize("name", ["dishes_info", "user_dishes_nested", "queue_dishes_nested"])
def test_reports_with_a_hot_dish_and_a_hot_venue(skew_session, monkeypatch, name):
    from platewise.operators import reports, views

    cat = full_skewed_catalog(skew_session)
    run = {"dishes_info": lambda: views.dishes_info(cat),
           "user_dishes_nested": lambda: reports.nested_as_text(reports.user_dishes(cat)),
           "queue_dishes_nested": lambda: reports.nested_as_text(reports.queue_dishes(cat))}[name]
    got = sorted(map(str, run().collect()))
    assert len(got) > 1000
    plan = run()._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan                                   # heavy keys were found
    plain = lambda large, small, key, how="inner", **_: large.join(small, key, how)
    monkeypatch.setattr(views, "salted_join", plain)
    monkeypatch.setattr(reports, "salted_join", plain)
    assert sorted(map(str, run().collect())) == got


def test_advanced_search_splits_a_hot_dish(skew_session):
    """Q5's join of menu rows and dishes: AQE splits the hot dish's partition, the ranking equals a plain count."""
    from platewise.operators import branches

    cat = full_skewed_catalog(skew_session)
    df = branches.menu_branch(cat, dish_term="red", with_ingredients=True)
    got = {r.id_restaurant: r.n_rows for r in df.collect()}
    names, links = {r.id: r.name for r in cat.dishes.collect()}, Counter(r.id_dish for r in cat.dish_ingredients.collect())
    want = Counter()
    for r in cat.menu.collect():
        if r.verified and "red" in names[r.id_dish]:
            want[r.id_restaurant] += links[r.id_dish]
    assert got == {v: n for v, n in want.items() if n}
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString() or "skewed" in df._jdf.queryExecution().executedPlan().toString()
