"""Contributor reports (per user) and moderator queues.

The reference answers the nested dish reports with one query per row (N+1);
here each is one plan: allergens are aggregated per (dish, ingredient), the
ingredient entries per dish, and only then joined to the (large) menu rows.

Every contributor report takes ``user=None`` for the batch form (all users at
once, keyed by ``user_id``) or a user id for one user's page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.catalog import WEEKDAYS, Catalog
from platewise.operators.branches import attach_cuisines
from platewise.operators.salted import salted_join


def _for_user(df: DataFrame, col: str, user) -> DataFrame:
    return df if user is None else df.where(F.col(col) == F.lit(user))


def _venues_with_cuisines(cat: Catalog, where) -> DataFrame:
    r = cat.restaurants.where(where).select(
        F.col("id").alias("id_restaurant"), "name", "opinion", "address", "verified", "updated_by")
    return (attach_cuisines(r, cat, distinct=False)
            .select(F.col("id_restaurant").alias("res_id"), F.col("name").alias("res_name"),
                    F.col("opinion").alias("res_score"), "res_cuisines",
                    F.col("address").alias("res_address"), F.col("verified").alias("res_ver"),
                    F.col("updated_by").alias("user_id")))


def dish_allergen_entries(cat: Catalog, keep_unlisted: bool = False) -> DataFrame:
    """(id_dish, ing) where ``ing`` is the sorted array of
    struct(ing_id, ing_name, allergens_names) for the dish's ingredients.

    As in the reference, ingredients without an allergen are dropped unless
    ``keep_unlisted`` (then ``allergens_names`` is NULL).
    """
    links = cat.dish_ingredients.select("id_dish", "id_ingredient").distinct()
    ing = cat.ingredients.select(F.col("id").alias("id_ingredient"), F.col("name").alias("ing_name"))
    alg = (cat.ingredient_allergens
           .join(cat.allergens.where(F.col("id") > 0)
                 .select(F.col("id").alias("id_allergen"), F.col("name").alias("allergen")), "id_allergen")
           .groupBy("id_ingredient")
           .agg(F.array_join(F.array_sort(F.collect_set("allergen")), ",").alias("allergens_names")))
    how = "left" if keep_unlisted else "inner"
    per_ing = links.join(ing, "id_ingredient").join(alg, "id_ingredient", how)
    return (per_ing.groupBy("id_dish")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("id_ingredient").alias("ing_id"), "ing_name", "allergens_names"))).alias("ing")))


def _nested_dishes(cat: Catalog, menu_rows: DataFrame, keep_unlisted: bool) -> DataFrame:
    r = cat.restaurants.select(F.col("id").alias("id_restaurant"), F.col("name").alias("res_name"))
    d = cat.dishes.select(F.col("id").alias("id_dish"), F.col("name").alias("dish_name"))
    entries = dish_allergen_entries(cat, keep_unlisted)
    empty = F.array().cast(entries.schema["ing"].dataType)
    # a dish on a third of the menus, or a venue with a third of the rows, is split
    dishes = d.join(entries, "id_dish", "left")
    return (salted_join(salted_join(menu_rows, dishes, "id_dish"), r, "id_restaurant")
            .select(F.col("id_restaurant").alias("res_id"), "res_name",
                    F.col("id_dish").alias("dish_id"), "dish_name",
                    F.col("verified").alias("dish_ver"),
                    F.col("updated_by").alias("user_id"),
                    F.coalesce(F.col("ing"), empty).alias("ing")))


def nested_as_text(df: DataFrame, col: str = "ing") -> DataFrame:
    """Render the nested ingredient list as ``id:name:allergens;...`` text."""
    txt = F.array_join(F.transform(F.col(col), lambda x: F.concat_ws(
        ":", x["ing_id"].cast("string"), x["ing_name"], F.coalesce(x["allergens_names"], F.lit("")))), ";")
    return df.withColumn(col, txt)


# -- contributor reports ---------------------------------------------------

def user_venues(cat: Catalog, user=None) -> DataFrame:
    return _for_user(_venues_with_cuisines(cat, F.lit(True)), "user_id", user)


def user_dishes(cat: Catalog, user=None, keep_unlisted: bool = False) -> DataFrame:
    m = _for_user(cat.menu, "updated_by", user)
    return _nested_dishes(cat, m, keep_unlisted)


def user_locations(cat: Catalog, user=None) -> DataFrame:
    c = cat.coordinates.where(~((F.col("pending_lat") == 0) & (F.col("pending_lon") == 0)))
    c = _for_user(c, "edited_by", user)
    return c.select(F.col("id").alias("res_id"), "lat", "lon",
                    F.col("pending_lat").alias("new_lat"), F.col("pending_lon").alias("new_lon"),
                    F.col("verified").alias("ver"), F.col("edited_by").alias("user_id"))


def _comments_with_venue(cat: Catalog, where) -> DataFrame:
    c = cat.comments.where(where).select(F.col("id").alias("id_comment"), "score", "comment",
                                          "verified", "updated_by")
    r = cat.restaurants.select(F.col("id").alias("id_restaurant"), F.col("name").alias("res_name"))
    return (c.join(cat.restaurant_comments, "id_comment").join(r, "id_restaurant")
            .select(F.col("id_comment").alias("c_id"), F.col("id_restaurant").alias("res_id"),
                    "res_name", "score", F.col("comment").alias("desc"),
                    F.col("verified").alias("ver"), F.col("updated_by").alias("user_id")))


def user_comments(cat: Catalog, user=None) -> DataFrame:
    """A user's comments, newest venue id first (the reference pins user 3;
    here the user is a parameter)."""
    return _for_user(_comments_with_venue(cat, F.lit(True)), "user_id", user).orderBy(
        F.desc("res_id"), "c_id")


def _hours_with_venue(cat: Catalog, hours: DataFrame) -> DataFrame:
    r = cat.restaurants.select(F.col("id").alias("id_restaurant"), F.col("name").alias("res_name"),
                               F.col("verified").alias("res_verified"),
                               F.col("deleted").alias("res_deleted"))
    return (hours.join(r, "id_restaurant")
            .select(F.col("id").alias("hours_id"), F.col("id_restaurant").alias("res_id"), "res_name",
                    *WEEKDAYS, F.to_json("special").alias("special"),
                    F.col("updated_by").alias("user_id"), "verified_by", "verified", "deleted",
                    "res_verified", "res_deleted"))


def user_hours(cat: Catalog, user=None) -> DataFrame:
    return _for_user(_hours_with_venue(cat, cat.hours.where(~F.col("deleted"))), "user_id", user)


# -- moderator queues --------------------------------------------------------

def queue_venues(cat: Catalog) -> DataFrame:
    return _venues_with_cuisines(cat, ~F.col("verified") & ~F.col("deleted")).drop("user_id")


def queue_dishes(cat: Catalog, keep_unlisted: bool = False) -> DataFrame:
    m = cat.menu.where(~F.col("verified") & ~F.col("deleted"))
    return _nested_dishes(cat, m, keep_unlisted).drop("user_id").orderBy("res_id", "dish_id")


def queue_locations(cat: Catalog) -> DataFrame:
    c = cat.coordinates.where(~F.col("verified")
                              & ~((F.col("pending_lat") == 0) & (F.col("pending_lon") == 0)))
    return c.select(F.col("id").alias("res_id"), "lat", "lon",
                    F.col("pending_lat").alias("new_lat"), F.col("pending_lon").alias("new_lon"),
                    F.col("verified").alias("ver"), F.col("updated_by").alias("up_by"),
                    F.col("edited_by").alias("ed_by"))


def queue_comments(cat: Catalog) -> DataFrame:
    return (_comments_with_venue(cat, ~F.col("verified") & ~F.col("deleted"))
            .drop("user_id").orderBy(F.desc("res_id"), "c_id"))


def queue_hours(cat: Catalog) -> DataFrame:
    return _hours_with_venue(cat, cat.hours.where(~F.col("verified") & ~F.col("deleted")))
