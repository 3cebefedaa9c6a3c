"""The named views (comments list, dish info, ingredient list, venue details)
and the id lookups built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.catalog import Catalog
from platewise.operators.branches import attach_cuisines
from platewise.operators.salted import dealt, in_order, salted_join, sketch


def _repeat_sorted(names, times, sep: str):
    """Sorted, non-distinct concatenation of ``names`` repeated ``times`` times:
    what GROUP_CONCAT returns over a join product with ``times`` copies."""
    return F.array_join(F.array_sort(F.flatten(F.array_repeat(names, times.cast("int")))), sep)


def _only(df: DataFrame, col: str, ids: DataFrame | None) -> DataFrame:
    """Restrict ``df`` to requested ids early (left-semi join on the link rows)."""
    if ids is None:
        return df
    return df.join(ids.select(F.col("_rid").alias(col)), col, "left_semi")


def comments_list(cat: Catalog, venue_ids: DataFrame | None = None) -> DataFrame:
    """Comments with their venue and author name (LEFT: authors may be missing).
    No deleted filter, as in the reference."""
    u = cat.users.select(F.col("id").alias("updated_by"), F.col("username").alias("up_by"))
    link = _only(cat.restaurant_comments, "id_restaurant", venue_ids).select(
        F.col("id_comment").alias("id"), F.col("id_restaurant").alias("res_id"))
    return (cat.comments.join(link, "id")
            .join(u, "updated_by", "left")
            .select("id", "comment", "up_by", "score", "res_id", "verified"))


def dishes_info(cat: Catalog, venue_ids: DataFrame | None = None) -> DataFrame:
    """Per (dish, venue) the ingredient names, one per row of the join product.

    The reference joins menu x ingredient rows and concatenates; a duplicated
    menu row repeats every ingredient.  Here the menu is counted per pair and
    the per-dish list (a recipe, small) is repeated that many times, so the
    product is never shuffled.  Dishes without ingredients drop (inner join).
    """
    # tasks take so many menu rows, however many there are
    sketched = sketch(cat.menu, "id_dish")
    m = (dealt(_only(cat.menu, "id_restaurant", venue_ids).select("id_dish", "id_restaurant"), sketched[0], "id_dish", "id_restaurant")
         .groupBy("id_dish", "id_restaurant").agg(F.count(F.lit(1)).alias("n_menu_rows")))
    ing = (cat.dish_ingredients
           .join(cat.ingredients.select(F.col("id").alias("id_ingredient"), F.col("name").alias("ing_name")),
                 "id_ingredient")
           .groupBy("id_dish").agg(F.collect_list("ing_name").alias("names")))
    d = cat.dishes.select(F.col("id").alias("id_dish"), "name", "calories", "price", "weight")
    # a dish that many venues serve is split
    rows = (salted_join(m, ing.join(d, "id_dish"), "id_dish", sketched=sketched)
            .select(F.col("id_dish").alias("id"), "name", "calories", "price", "weight",
                    _repeat_sorted(F.col("names"), F.col("n_menu_rows"), ",").alias("ingredient_names"),
                    F.col("id_restaurant").alias("res_id")))
    return in_order(rows, sketched[0], "id", "res_id")


def ingredients_list(cat: Catalog, dish_ids: DataFrame | None = None) -> DataFrame:
    """Per (ingredient, dish) the allergen names (', '-separated, 'None' if none)."""
    link = (_only(cat.dish_ingredients, "id_dish", dish_ids).groupBy("id_ingredient", "id_dish")
            .agg(F.count(F.lit(1)).alias("n_link_rows")))
    alg = (cat.ingredient_allergens
           .join(cat.allergens.select(F.col("id").alias("id_allergen"), F.col("name").alias("allergen")),
                 "id_allergen", "left")
           .groupBy("id_ingredient").agg(F.collect_list("allergen").alias("names")))
    i = cat.ingredients.select(F.col("id").alias("id_ingredient"), "name", "vegetarian", "vegan")
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    return (i.join(link, "id_ingredient").join(alg, "id_ingredient", "left")
            .select(F.col("id_ingredient").alias("id"), "name", "vegetarian", "vegan",
                    F.col("id_dish").alias("dish_id"),
                    F.when(F.size(names) == 0, F.lit("None"))
                    .otherwise(_repeat_sorted(names, F.col("n_link_rows"), ", ")).alias("allergens_list"))
            .orderBy("id", "dish_id"))


def venue_details(cat: Catalog, venue_ids: DataFrame | None = None) -> DataFrame:
    """Venue with location, cuisines (non-distinct) and the names of the
    contributor and the verifying admin (the users table joined twice)."""
    client = cat.users.select(F.col("id").alias("updated_by"), F.col("username").alias("up_by"))
    admin = cat.users.select(F.col("id").alias("verified_by"), F.col("username").alias("ver_by"))
    co = cat.coordinates.select(F.col("id").alias("id_restaurant"), "lat", "lon")
    r = _only(cat.restaurants.select(F.col("id").alias("id_restaurant"), "name", "opinion", "address",
                                     "updated_by", "verified_by"), "id_restaurant", venue_ids)
    return (attach_cuisines(r, cat, distinct=False)
            .join(co, "id_restaurant")
            .join(client, "updated_by", "left")
            .join(admin, "verified_by", "left")
            .select("name", "opinion", "lat", "lon", "address", "res_cuisines", "up_by", "ver_by",
                    F.col("id_restaurant").alias("res_id")))


def positive_ids(requests: DataFrame, col: str = "id") -> DataFrame:
    """Requested ids, kept only when ``Number(id) > 0`` as in the reference."""
    return requests.select(F.col(col).alias("_rid")).where(F.col("_rid") > 0)


def venue_info(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Batch form of the by-id lookups: the request ids restrict the link
    tables before any join or aggregate."""
    return venue_details(cat, positive_ids(requests))


def venue_comments(cat: Catalog, requests: DataFrame) -> DataFrame:
    """Verified comments of the requested venues (deleted not checked, as in the reference)."""
    return comments_list(cat, positive_ids(requests)).where(F.col("verified"))


def venue_dishes(cat: Catalog, requests: DataFrame) -> DataFrame:
    return dishes_info(cat, positive_ids(requests))


def dish_ingredients_lookup(cat: Catalog, requests: DataFrame) -> DataFrame:
    return ingredients_list(cat, positive_ids(requests))


def cuisine_types(cat: Catalog) -> DataFrame:
    return cat.cuisines.select("type")
