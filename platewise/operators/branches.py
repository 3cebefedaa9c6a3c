"""Per-venue branch aggregates shared by searches, views and reports.

The reference ranks by ``count(*)`` over a join product of independent
branches (menu rows x ingredient rows x cuisine rows).  Aggregating every
branch on its own key first and multiplying the counts gives the same
numbers without materialising the product, and each aggregate is
partial-aggregated map side, so a venue holding a third of all menu rows is
reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.catalog import Catalog
from platewise.functions.agg import concat_sorted, concat_sorted_distinct
from platewise.functions.text import contains_ci


def attach_cuisines(venues: DataFrame, cat: Catalog, distinct: bool = True) -> DataFrame:
    """Add n_cuisine_rows and res_cuisines to ``venues`` (one row per
    ``id_restaurant``), keeping only venues with a cuisine (inner join).

    The candidate rows themselves are joined to the link rows and grouped
    once, so only the candidates' links are aggregated (no second pass over
    the candidates, no aggregate over every venue); the candidates' other
    columns ride along with ``any_value`` (one row per venue).
    """
    c = cat.cuisines.select(F.col("id").alias("id_cuisine"), "type")
    links = cat.restaurant_cuisines.join(c, "id_cuisine").select("id_restaurant", "type")
    concat = concat_sorted_distinct if distinct else concat_sorted
    others = [x for x in venues.columns if x != "id_restaurant"]
    return (venues.join(links, "id_restaurant")
            .groupBy("id_restaurant")
            .agg(*[F.any_value(x).alias(x) for x in others],
                 F.count(F.lit(1)).alias("n_cuisine_rows"), concat("type").alias("res_cuisines")))


def dish_ingredient_branch(cat: Catalog, ing_term: str | None = None,
                           fold_accents: bool = False) -> DataFrame:
    """(id_dish, n_ing_rows, ing_names array) for dishes with a (matching) ingredient."""
    ing = cat.ingredients.select(F.col("id").alias("id_ingredient"), F.col("name").alias("ing_name"))
    if ing_term is not None:
        ing = ing.where(contains_ci(F.col("ing_name"), ing_term, fold_accents))
    return (cat.dish_ingredients.join(ing, "id_ingredient")
            .groupBy("id_dish")
            .agg(F.count(F.lit(1)).alias("n_ing_rows"),
                 F.collect_set("ing_name").alias("ing_names")))


def menu_branch(cat: Catalog, dish_term: str | None = None, ing_term: str | None = None,
                with_ingredients: bool = False, vegetarian: bool = False,
                vegan: bool = False, fold_accents: bool = False) -> DataFrame:
    """Verified menu rows of matching dishes, aggregated per venue.

    Returns (id_restaurant, n_rows, dish_names[, ing_names]) where ``n_rows``
    is the number of rows the reference's join product would hold for the
    venue before the cuisine fan-out.

    The dish side (filtered dishes, with their per-dish ingredient aggregate)
    is joined to the menu first, so a selective term prunes the large menu
    before any shuffle (broadcast or runtime filter when the dish side is
    small); then one partial-aggregated shuffle on the venue.
    """
    d = cat.dishes.select(F.col("id").alias("id_dish"), F.col("name").alias("dish_name"),
                          "vegetarian", "vegan")
    if dish_term is not None:
        d = d.where(contains_ci(F.col("dish_name"), dish_term, fold_accents))
    if vegetarian:
        d = d.where(F.col("vegetarian"))
    if vegan:
        d = d.where(F.col("vegan"))
    d = d.select("id_dish", "dish_name")
    if with_ingredients:
        d = d.join(dish_ingredient_branch(cat, ing_term, fold_accents), "id_dish")
        n = F.col("n_ing_rows")
    else:
        n = F.lit(1)
    menu = cat.menu.where(F.col("verified")).select("id_restaurant", "id_dish")
    aggs = [F.sum(n).cast("long").alias("n_rows"), concat_sorted_distinct("dish_name").alias("dish_names")]
    if with_ingredients:
        aggs.append(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ing_names")))), ",")
                    .alias("ing_names"))
    return menu.join(d, "id_dish").groupBy("id_restaurant").agg(*aggs)
