"""Hand-written micro-tables (FIXTURES.md part B) as a Catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

from platewise.catalog import Catalog

HOURS_SCHEMA = ("id long, id_restaurant long, mon string, tue string, wed string, thu string, "
                "fri string, sat string, sun string, special map<string,string>, updated_by long, "
                "verified_by long, verified boolean, deleted boolean")


def hours_row(i, venue, weekday, sat, sun, special, verified, deleted):
    return (i, venue, weekday, weekday, weekday, weekday, weekday, sat, sun, special, 0, 0,
            verified, deleted)


def catalog(spark: SparkSession) -> Catalog:
    c = spark.createDataFrame
    restaurants = c([
        (1, "Alpha Grill", 0.0, True, "a", 1, 0, False),
        (2, "Beta grill", 0.0, True, "b", 2, 0, False),
        (3, "Gamma Diner", 0.0, False, "c", 9, 0, False),
        (4, "Delta", 0.0, True, "d", 1, 0, False),
        (5, "Epsilon", 0.0, True, "e", 2, 0, False),
    ], "id long, name string, opinion double, verified boolean, address string, updated_by long, "
       "verified_by long, deleted boolean")
    cuisines = c([(1, "Thai"), (2, "Vegan"), (3, "BBQ")], "id long, type string")
    restaurant_cuisines = c([(1, 1), (1, 2), (2, 3), (2, 3), (3, 1), (5, 2)],
                            "id_restaurant long, id_cuisine long")
    dishes = c([(10, "Green Salad", 100, 5.0, 20.0, False, False),
                (11, "Beef Stew", 500, 9.0, 100.0, False, False),
                (12, "Salad Bowl", 150, 6.0, 30.0, False, False),
                (13, "Plain Rice", 200, 2.0, 40.0, False, False)],
               "id long, name string, calories int, price double, weight double, vegetarian boolean, vegan boolean")
    menu = c([(1, 10, True), (1, 12, True), (2, 10, True), (2, 10, False), (3, 10, True),
              (4, 11, True), (5, 11, True), (5, 13, False)],
             "id_restaurant long, id_dish long, verified boolean").selectExpr(
        "*", "CAST(1 AS long) AS updated_by", "CAST(0 AS long) AS verified_by", "false AS deleted")
    ingredients = c([(100, "Lettuce", True, True), (101, "Cheese", True, False), (102, "Beef", False, False)],
                    "id long, name string, vegetarian boolean, vegan boolean")
    dish_ingredients = c([(100, 10), (101, 10), (102, 11), (100, 12), (100, 12)],
                         "id_ingredient long, id_dish long")
    allergens = c([(200, "Milk"), (201, "Lactose")], "id long, name string")
    ingredient_allergens = c([(200, 101), (201, 101), (200, 101)], "id_allergen long, id_ingredient long")
    coordinates = c([
        (1, True, 51.10, 17.03, 0.0, 0.0, 0, 0, 0),
        (2, True, 51.12, 17.05, 0.0, 0.0, 0, 0, 0),
        (3, True, 51.10, 17.03, 0.0, 0.0, 0, 0, 0),
        (4, True, 0.0, 0.0, 0.0, 0.0, 0, 0, 0),
        (5, True, 51.30, 17.30, 0.0, 0.0, 0, 0, 0),
    ], "id long, verified boolean, lat double, lon double, pending_lat double, pending_lon double, "
       "updated_by long, verified_by long, edited_by long")
    hours = c([
        hours_row(1, 1, "08:00-18:00", "closed", "closed",
                  {"06.01.2025": "closed", "07.01.2025": "10:00-12:00"}, True, False),
        hours_row(2, 2, "closed", "closed", "closed", None, False, False),
        hours_row(3, 5, "10:00-17:00", "10:00-17:00", "10:00-17:00", None, True, True),
        hours_row(4, 5, "08:00-12:00", "08:00-12:00", "08:00-12:00", None, True, False),
        hours_row(5, 4, "08:00-12:00", "08:00-12:00", "08:00-12:00", None, True, False),
    ], HOURS_SCHEMA)
    comments = c([(1, "Tasty", 4.0, True, 7, 1, False)],
                 "id long, comment string, score double, verified boolean, updated_by long, "
                 "verified_by long, deleted boolean")
    restaurant_comments = c([(1, 1)], "id_restaurant long, id_comment long")
    users = c([(1, "admin", "admin@aa.aa", "admin", True), (2, "tester", "tester@aa.aa", "tester", False),
               (3, "test", "test@test.te", "tester2", True), (7, "seven", "s@x.pl", "seven", False)],
              "id long, login string, email string, username string, is_admin boolean")
    return Catalog(restaurants=restaurants, cuisines=cuisines, restaurant_cuisines=restaurant_cuisines,
                   dishes=dishes, menu=menu, ingredients=ingredients, dish_ingredients=dish_ingredients,
                   allergens=allergens, ingredient_allergens=ingredient_allergens,
                   coordinates=coordinates, hours=hours, comments=comments,
                   restaurant_comments=restaurant_comments, users=users)
