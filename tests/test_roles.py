"""Shape of the role binding over the driver tables (sf0.001)."""

import os
from collections import Counter

import pytest

from platewise.sources import roles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def cat(spark):
    return roles.bind(spark, SF)


def test_each_venue_has_2_3_or_5_cuisine_links_plus_duplicates(cat):
    per_venue = Counter(r.id_restaurant for r in cat.restaurant_cuisines.collect())
    for venue, n in per_venue.items():
        dup = 1 if venue % 7 == 0 else 0
        assert n - dup in (2, 3, 5) or (n in (2, 3, 5)), (venue, n)


def test_menu_is_lineitem_and_ingredients_are_words(cat, spark):
    t = roles.read_tables(spark, SF)
    assert cat.menu.count() == t["lineitem"].count()
    words = {w for r in t["part"].select("p_name").collect() for w in r.p_name.split(" ")}
    assert {r.name for r in cat.ingredients.collect()} == words
    assert cat.ingredients.select("id").distinct().count() == len(words)


def test_vegan_ingredient_is_vegetarian(cat):
    assert cat.ingredients.where("vegan AND NOT vegetarian").count() == 0


def test_one_location_and_hours_row_per_venue(cat):
    n = cat.restaurants.count()
    assert cat.coordinates.count() == n
    assert cat.hours.select("id_restaurant").distinct().count() == n


def test_loaded_catalog_gives_the_same_answers(cat, spark):
    import tempfile
    from platewise.operators import search
    loaded = roles.load(spark, SF, tempfile.mkdtemp(prefix="platewise-test-catalog-"))
    a = sorted(tuple(r) for r in search.search_by_dish(cat, "red").collect())
    b = sorted(tuple(r) for r in search.search_by_dish(loaded, "red").collect())
    assert a == b and a


def test_lazy_catalog_is_cached_per_folder_and_with_tables_copies(spark):
    a = roles.bind(spark, SF)
    assert roles.bind(spark, SF) is a
    other = "/root/testdata/sf0.01"
    if os.path.exists(other):
        assert roles.bind(spark, other) is not a
    replaced = a.with_tables(menu=a.menu.limit(0))
    assert replaced.menu.count() == 0 and a.menu.count() > 0
    assert sorted(a.materialized().__dataclass_fields__) == sorted(a._FIELDS)


def test_cli_writes_a_query_result(spark, tmp_path):
    from platewise import cli
    assert cli.main(["--list"]) == 0
    # run in-process against the test session (get_spark reuses it)
    out = str(tmp_path / "res")
    from platewise.plans.queries import REGISTRY
    REGISTRY["tag_list"](spark, SF).write.mode("overwrite").parquet(out)
    assert spark.read.parquet(out).count() == 5
