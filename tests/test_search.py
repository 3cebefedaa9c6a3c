import datetime as dt

import pytest

from platewise.operators import search
from tests.fixtures import catalog


@pytest.fixture(scope="module")
def cat(spark):
    return catalog(spark)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_search_by_name_is_case_insensitive_and_not_distinct(cat):
    got = rows(search.search_by_name(cat, "grill"), "res_id", "res_cuisines")
    assert got == [(1, "Thai,Vegan"), (2, "BBQ,BBQ")]


def test_search_by_dish_fanout_score(cat):
    got = rows(search.search_by_dish(cat, "salad"), "res_id", "sort_score", "dish_names", "res_cuisines")
    assert got == [(1, 4, "Green Salad,Salad Bowl", "Thai,Vegan"), (2, 2, "Green Salad", "BBQ")]


def test_search_by_ingredient_counts_ingredient_rows(cat):
    got = rows(search.search_by_ingredient(cat, "lettuce"), "res_id", "sort_score")
    assert got == [(1, 6), (2, 2)]


def test_advanced_search_ingredient_drops_venue_without_cuisine(cat):
    got = rows(search.advanced_search(cat, ing_name="beef", as_of=dt.datetime(2025, 1, 7, 12)),
               "res_id", "sort_score", "hours")
    assert got == [(5, 1, "08:00-12:00")]


def test_advanced_search_open_now_filters(cat):
    at = dt.datetime(2025, 1, 7, 12, 0, 1)
    assert search.advanced_search(cat, ing_name="beef", now_open=True, as_of=at).count() == 0
    at = dt.datetime(2025, 1, 7, 12, 0, 0)
    assert search.advanced_search(cat, ing_name="beef", now_open=True, as_of=at).count() == 1


def test_radius_search_distances(cat):
    got = rows(search.search_by_radius(cat, 51.10, 17.03, 50.0), "res_id", "distance_km")
    assert [r for r, _ in got] == [1, 3, 2, 5]
    d = dict(got)
    assert d[1] == 0.0 and d[3] == 0.0
    assert round(d[2], 3) == 2.626 and round(d[5], 3) == 29.129


def test_radius_search_swapped_axes_reproduce_reference(cat):
    got = dict(rows(search.search_by_radius(cat, 17.03, 51.10, 50.0, swap_axes=True), "res_id", "distance_km"))
    assert round(got[2], 3) == 3.077 and round(got[5], 3) == 36.781 and got[1] == 0.0


def test_radius_excludes_unknown_location(cat):
    got = rows(search.search_by_radius(cat, 0.0001, 0.0001, 100.0), "res_id")
    assert got == []


@pytest.mark.parametrize("term", ["a b", "a%", "", "é", "abc\n", None, "_"])
def test_bad_terms_rejected(cat, term):
    with pytest.raises(ValueError):
        search.search_by_name(cat, term)
    with pytest.raises(ValueError):
        search.search_by_dish(cat, term)


def test_advanced_search_needs_a_criterion(cat):
    with pytest.raises(ValueError):
        search.advanced_search(cat, vegan=True)
    with pytest.raises(ValueError):
        search.advanced_search(cat, dish_name="a b")


def test_limit_is_top_k(cat):
    got = rows(search.search_by_dish(cat, "salad", limit=1), "res_id")
    assert got == [(1,)]


def test_accent_folding_is_opt_in(spark, cat):
    r = spark.createDataFrame([(7, "Café Olé", 0.0, True, "x", 1, 0, False)], cat.restaurants.schema)
    rc = spark.createDataFrame([(7, 1)], cat.restaurant_cuisines.schema)
    c2 = cat.with_tables(restaurants=cat.restaurants.unionByName(r),
                         restaurant_cuisines=cat.restaurant_cuisines.unionByName(rc))
    assert rows(search.search_by_name(c2, "cafe"), "res_id") == []
    assert rows(search.search_by_name(c2, "cafe", fold_accents=True), "res_id") == [(7,)]


def test_searches_come_in_order_and_limits_take_the_first(cat):
    """Row order and limits, which a comparison of row sets cannot show."""
    runs = [(lambda **k: search.search_by_dish(cat, "a", **k), lambda r: (-r.sort_score, r.res_id)),
            (lambda **k: search.search_by_name(cat, "a", **k), lambda r: r.res_id),
            (lambda **k: search.search_by_radius(cat, 51.1, 17.03, 500.0, **k), lambda r: (r.distance_km, r.res_id))]
    for run, key in runs:
        rows = run().collect()
        assert len(rows) >= 2 and rows == sorted(rows, key=key)
        for n in (0, 1, 2, 100):
            assert run(limit=n).collect() == rows[:n]
