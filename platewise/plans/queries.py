"""Registered queries over the driver's tables: name -> fn(spark, sf_dir) -> DataFrame.

Parameters are fixed here; every query reads whole tables through the role
binding (no id subsets).  Search terms are the feature of the search.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.functions import geo
from platewise.operators import calendar, generate, geo_join, gram_index, ingest, moderation, reports, search, views
from platewise.sources import files, roles, spatial
from platewise.streaming import commands as streams

# Fixed parameters of the registered queries (mirrored in plans/oracle.py).
NAME_TERM = "supplier"
DISH_TERM = "red"
ING_TERM = "o"
PROBE_LAT, PROBE_LON, PROBE_RADIUS_KM = 51.1, 17.03, 5.0
AS_OF = _dt.datetime(2024, 1, 15, 12, 0, 0)     # a Monday inside the event range
CALENDAR_START = _dt.date(2024, 1, 12)          # a Friday: crosses a weekend
CALENDAR_DAYS = 7

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@register("search_by_name")
def q_search_by_name(spark, sf_dir):
    return search.search_by_name(roles.bind(spark, sf_dir), NAME_TERM)


@register("search_by_name_accent_folded")
def q_search_by_name_folded(spark, sf_dir):
    # the reference's collation ignores case and accents
    return search.search_by_name(roles.bind(spark, sf_dir), NAME_TERM, fold_accents=True)


@register("search_by_dish")
def q_search_by_dish(spark, sf_dir):
    return search.search_by_dish(roles.bind(spark, sf_dir), DISH_TERM)


@register("search_by_ingredient")
def q_search_by_ingredient(spark, sf_dir):
    return search.search_by_ingredient(roles.bind(spark, sf_dir), ING_TERM)


@register("search_by_radius")
def q_search_by_radius(spark, sf_dir):
    return search.search_by_radius(roles.bind(spark, sf_dir), PROBE_LAT, PROBE_LON, PROBE_RADIUS_KM)


@register("search_by_radius_swapped")
def q_search_by_radius_swapped(spark, sf_dir):
    # the reference's axis convention: stored latitude read as longitude
    return search.search_by_radius(roles.bind(spark, sf_dir), PROBE_LON, PROBE_LAT,
                                   PROBE_RADIUS_KM, swap_axes=True)


@register("search_by_dish_top")
def q_search_by_dish_top(spark, sf_dir):
    """The ten best venues, with their places in the ranking."""
    top = search.search_by_dish(roles.bind(spark, sf_dir), DISH_TERM, limit=10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sort_score"), "res_id")))


@register("search_by_radius_top")
def q_search_by_radius_top(spark, sf_dir):
    """The seven nearest venues, with their places."""
    top = search.search_by_radius(roles.bind(spark, sf_dir), PROBE_LAT, PROBE_LON, PROBE_RADIUS_KM, limit=7)
    return top.withColumn("place", F.row_number().over(Window.orderBy("distance_km", "res_id")))


@register("advanced_search_swapped")
def q_adv_swapped(spark, sf_dir):
    return search.advanced_search(roles.bind(spark, sf_dir), lat=PROBE_LON, lon=PROBE_LAT, radius_km=6.0,
                                  now_open=True, as_of=AS_OF, swap_axes=True)


@register("json_rows")
def q_json_rows(spark, sf_dir):
    """Dishes as JSON objects."""
    return files.rows_as_json(roles.bind(spark, sf_dir).dishes.select("id", "name"))


@register("advanced_search_name_dish")
def q_adv_name_dish(spark, sf_dir):
    return search.advanced_search(roles.bind(spark, sf_dir), res_name=NAME_TERM,
                                  dish_name="ring", as_of=AS_OF)


@register("advanced_search_radius_open")
def q_adv_radius_open(spark, sf_dir):
    return search.advanced_search(roles.bind(spark, sf_dir), lat=PROBE_LAT, lon=PROBE_LON,
                                  radius_km=6.0, now_open=True, as_of=AS_OF)


@register("advanced_search_diet")
def q_adv_diet(spark, sf_dir):
    return search.advanced_search(roles.bind(spark, sf_dir), ing_name="e", vegetarian=True,
                                  as_of=AS_OF)


@register("advanced_search_all")
def q_adv_all(spark, sf_dir):
    # every criterion at once, as in the reference's hand-written sample query
    return search.advanced_search(roles.bind(spark, sf_dir), res_name=NAME_TERM, dish_name="e",
                                  ing_name="o", lat=51.0, lon=17.0, radius_km=200.0,
                                  now_open=True, as_of=AS_OF)


@register("effective_hours")
def q_effective_hours(spark, sf_dir):
    return calendar.effective_hours_on(roles.bind(spark, sf_dir).hours, AS_OF.date())


@register("weekly_calendar")
def q_weekly_calendar(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    return calendar.weekly_calendar(cat.restaurants, cat.hours, CALENDAR_START, CALENDAR_DAYS)


@register("calendar_for_venue")
def q_calendar_for_venue(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return calendar.calendar_lookup(cat.restaurants, cat.hours, roles.view_requests(t), CALENDAR_START,
                                    CALENDAR_DAYS)


@register("open_now")
def q_open_now(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    return calendar.open_now(cat.restaurants, cat.hours, AS_OF)


@register("open_now_overnight")
def q_open_now_overnight(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    # a Saturday late evening: weekend ranges like 22:00-02:00 wrap midnight
    return calendar.open_now(cat.restaurants, cat.hours, _dt.datetime(2024, 1, 13, 23, 30),
                             overnight=True)


@register("open_now_after_midnight")
def q_open_now_after_midnight(spark, sf_dir):
    # Sunday 01:30: Saturday's 22:00-02:00 ranges are still open
    cat = roles.bind(spark, sf_dir)
    return calendar.open_now(cat.restaurants, cat.hours, _dt.datetime(2024, 1, 14, 1, 30),
                             overnight=True)


@register("validate_hours")
def q_validate_hours(spark, sf_dir):
    return calendar.validate_weekly(roles.bind(spark, sf_dir).hours)


# -- views and lookups --------------------------------------------------------


@register("comments_list")
def q_comments_list(spark, sf_dir):
    return views.comments_list(roles.bind(spark, sf_dir))


@register("dishes_info")
def q_dishes_info(spark, sf_dir):
    return views.dishes_info(roles.bind(spark, sf_dir))


@register("ingredients_list")
def q_ingredients_list(spark, sf_dir):
    return views.ingredients_list(roles.bind(spark, sf_dir))


@register("venue_details")
def q_venue_details(spark, sf_dir):
    return views.venue_details(roles.bind(spark, sf_dir))


@register("venue_info_lookup")
def q_venue_info_lookup(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    return views.venue_info(roles.bind(spark, sf_dir), roles.view_requests(t))


@register("comments_for_venue")
def q_comments_for_venue(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    return views.venue_comments(roles.bind(spark, sf_dir), roles.view_requests(t))


@register("dishes_for_venue")
def q_dishes_for_venue(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    return views.venue_dishes(roles.bind(spark, sf_dir), roles.view_requests(t))


@register("ingredients_for_dish")
def q_ingredients_for_dish(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    return views.dish_ingredients_lookup(roles.bind(spark, sf_dir), roles.dish_requests(t))


@register("tag_list")
def q_tag_list(spark, sf_dir):
    return views.cuisine_types(roles.bind(spark, sf_dir))


@register("radius_join_many")
def q_radius_join_many(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    targets = (cat.coordinates.where((F.col("lat") > 0) & (F.col("lon") > 0))
               .select(F.col("id").alias("res_id"), "lat", "lon"))
    return geo_join.radius_join(roles.probe_points(t), targets, 0.5)


# -- contributor reports and moderator queues ----------------------------------

@register("user_venues")
def q_user_venues(spark, sf_dir):
    return reports.user_venues(roles.bind(spark, sf_dir))


@register("user_dishes_nested")
def q_user_dishes_nested(spark, sf_dir):
    return reports.nested_as_text(reports.user_dishes(roles.bind(spark, sf_dir)))


@register("user_locations")
def q_user_locations(spark, sf_dir):
    return reports.user_locations(roles.bind(spark, sf_dir))


@register("user_comments")
def q_user_comments(spark, sf_dir):
    return reports.user_comments(roles.bind(spark, sf_dir))


@register("user_hours")
def q_user_hours(spark, sf_dir):
    return reports.user_hours(roles.bind(spark, sf_dir))


@register("queue_venues")
def q_queue_venues(spark, sf_dir):
    return reports.queue_venues(roles.bind(spark, sf_dir))


@register("queue_dishes_nested")
def q_queue_dishes_nested(spark, sf_dir):
    return reports.nested_as_text(reports.queue_dishes(roles.bind(spark, sf_dir)))


@register("queue_locations")
def q_queue_locations(spark, sf_dir):
    return reports.queue_locations(roles.bind(spark, sf_dir))


@register("queue_comments")
def q_queue_comments(spark, sf_dir):
    return reports.queue_comments(roles.bind(spark, sf_dir))


@register("queue_hours")
def q_queue_hours(spark, sf_dir):
    return reports.queue_hours(roles.bind(spark, sf_dir))


# -- moderation folds --------------------------------------------------------------


@register("role_gate")
def q_role_gate(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return moderation.role_gate(roles.commands(t), cat.users).select("event_id", "key", "action", "actor")


@register("moderate_flags")
def q_moderate_flags(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return moderation.moderate_flags(cat.restaurants, roles.moderation_commands(t), cat.users)


@register("moderate_comments")
def q_moderate_comments(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return moderation.moderate_flags(cat.comments, roles.comment_commands(t), cat.users)


@register("moderate_menu")
def q_moderate_menu(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    new_menu, _ = moderation.moderate_menu(roles.bind(spark, sf_dir), roles.menu_commands(t))
    return new_menu


@register("moderate_menu_diet")
def q_moderate_menu_diet(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    _, new_dishes = moderation.moderate_menu(roles.bind(spark, sf_dir), roles.menu_commands(t))
    return new_dishes.select("id", "vegetarian", "vegan")


@register("derive_diet_flags")
def q_derive_diet_flags(spark, sf_dir):
    return moderation.derive_diet_flags(roles.bind(spark, sf_dir)).select("id", "vegetarian", "vegan")


@register("moderate_locations")
def q_moderate_locations(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    cmds = moderation.location_commands(roles.location_commands(t), cat.restaurants, cat.users)
    return moderation.moderate_locations(cat.coordinates, cmds)


@register("validate_special")
def q_validate_special(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    p = moderation.validate_hours_proposals(roles.hours_proposals(t))
    return p.select("event_id", "special_text", "valid", "reason")


@register("moderate_hours")
def q_moderate_hours(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    out = moderation.moderate_hours(cat.hours, roles.hours_proposals(t), roles.moderation_commands(t),
                                    cat.restaurants, cat.users)
    return out.withColumn("special", F.to_json("special"))


@register("moderate_hours_by_id")
def q_moderate_hours_by_id(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    out = moderation.moderate_hours_by_id(cat.hours, roles.hours_proposals(t), roles.hours_commands(t),
                                          cat.restaurants, cat.users)
    return out.withColumn("special", F.to_json("special"))


@register("upsert_comments")
def q_upsert_comments(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return moderation.upsert_comments(cat.comments, cat.restaurant_comments,
                                      roles.comment_submissions(t), cat.restaurants, cat.users)


# -- ingestion --------------------------------------------------------------------------


def _ingested_venues(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return cat, ingest.ingest_venues(cat.restaurants, cat.cuisines, roles.venue_submissions(t), cat.users)


@register("ingest_venues")
def q_ingest_venues(spark, sf_dir):
    _, (new, _links, _rej) = _ingested_venues(spark, sf_dir)
    return new


@register("ingest_venue_links")
def q_ingest_venue_links(spark, sf_dir):
    _, (_new, links, _rej) = _ingested_venues(spark, sf_dir)
    return links


@register("ingest_venue_rejects")
def q_ingest_venue_rejects(spark, sf_dir):
    _, (_new, _links, rej) = _ingested_venues(spark, sf_dir)
    return rej


@register("default_coordinates")
def q_default_coordinates(spark, sf_dir):
    cat, (new, _links, _rej) = _ingested_venues(spark, sf_dir)
    venues = cat.restaurants.select("id").unionByName(new.select("id"))
    return ingest.default_coordinates(venues, cat.coordinates)


@register("default_hours")
def q_default_hours(spark, sf_dir):
    cat, (new, _links, _rej) = _ingested_venues(spark, sf_dir)
    venues = cat.restaurants.select("id").unionByName(new.select("id"))
    return ingest.default_hours(venues, cat.hours).drop("special")


def _ingested_dishes(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    cat = roles.bind(spark, sf_dir)
    return ingest.ingest_dishes(cat.dishes, cat.ingredients, cat.allergens, cat.restaurants, cat.users,
                                roles.dish_requests_json(t))


@register("ingest_dishes")
def q_ingest_dishes(spark, sf_dir):
    out = _ingested_dishes(spark, sf_dir)
    return out["dishes"].join(out["menu"].select(F.col("id_dish").alias("id"), F.col("id_restaurant").alias("res_id")),
                              "id")


@register("ingest_allergens")
def q_ingest_allergens(spark, sf_dir):
    return _ingested_dishes(spark, sf_dir)["allergens"]


@register("ingest_dish_links")
def q_ingest_dish_links(spark, sf_dir):
    out = _ingested_dishes(spark, sf_dir)
    ing = out["ingredients"].select(F.col("id").alias("id_ingredient"), F.col("name").alias("ing_name"))
    return (out["dish_ingredients"].join(ing, "id_ingredient")
            .join(out["ingredient_allergens"], "id_ingredient", "left")
            .select("id_dish", "id_ingredient", "ing_name", "id_allergen"))


@register("validate_users")
def q_validate_users(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    return ingest.validate_users(roles.bind(spark, sf_dir).users, roles.registrations(t))


# -- sources, sinks and dataset steps ----------------------------------------------------


@register("text_lines")
def q_text_lines(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    path = streams.run_dir(spark, "text-lines")
    t["customer"].select(F.concat(F.lit("  "), "c_name", F.lit(" \t")).alias("value")).write.text(path)
    return files.read_text_lines(spark, path)


@register("address_format")
def q_address_format(spark, sf_dir):
    t = roles.read_tables(spark, sf_dir)
    path = streams.run_dir(spark, "addresses")
    (t["customer"].select(F.col("c_mktsegment").alias("street"), F.col("c_nationkey").cast("string").alias("no"),
                          F.concat(F.lit("50-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("zip"),
                          F.lit("Wroclaw").alias("city"))
     .write.csv(path))
    return files.read_addresses(spark, path).select("address")


@register("json_array_roundtrip")
def q_json_array_roundtrip(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    path = streams.run_dir(spark, "json-arrays")
    d = cat.dishes.select("id", "name", "calories", "price", "weight")
    files.write_json_arrays(d, path, rows_per_array=256)
    return files.read_json_arrays(spark, path, d.schema)


@register("json_array_whole_file")
def q_json_array_whole_file(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    path = streams.run_dir(spark, "json-files")
    d = cat.dishes.select("id", "name", "calories", "price", "weight")
    files.write_json_files(d, path)
    return files.read_json_arrays(spark, path, d.schema, whole_file=True)


@register("wkb_decode")
def q_wkb_decode(spark, sf_dir):
    c = roles.bind(spark, sf_dir).coordinates
    blobs = c.select("id", files.encode_point(F.col("lat"), F.col("lon")).alias("wkb"))
    return blobs.select("id", files.decode_point(F.col("wkb")).alias("p")).select(
        "id", F.col("p.x").alias("lat"), F.col("p.y").alias("lon"))


@register("distinct_sample")
def q_distinct_sample(spark, sf_dir):
    return generate.distinct_sample(roles.bind(spark, sf_dir).dishes, "name", 20)


@register("name_product_sample")
def q_name_product_sample(spark, sf_dir):
    # adjectives x nouns taken from the dish names, 20 distinct combinations
    p = roles.read_tables(spark, sf_dir)["part"]
    first = p.select(F.split("p_name", " ").getItem(0).alias("w"))
    second = p.select(F.split("p_name", " ").getItem(1).alias("w"))
    return generate.product_sample(first, second, 20)


@register("distinct_pairs")
def q_distinct_pairs(spark, sf_dir):
    return generate.distinct_pairs(roles.bind(spark, sf_dir).dish_ingredients, ["id_ingredient", "id_dish"])


@register("derived_measure")
def q_derived_measure(spark, sf_dir):
    return generate.derived_weight(roles.bind(spark, sf_dir).dishes)


# -- stored search layouts ----------------------------------------------------------------

@register("search_terms_batch")
def q_search_terms_batch(spark, sf_dir):
    """Dishes whose name contains each of a table of terms (parts of nation and region names, one to five letters)."""
    t, cat = roles.read_tables(spark, sf_dir), roles.bind(spark, sf_dir)
    path = streams.run_dir(spark, "grams")
    gram_index.write_index(cat.dishes, path)
    return gram_index.search_terms(spark, path, roles.search_terms(t))


@register("search_by_radius_layout")
def q_search_by_radius_layout(spark, sf_dir):
    """The radius search on coordinates stored along a space-filling curve."""
    cat = roles.bind(spark, sf_dir)
    path = streams.run_dir(spark, "points")
    spatial.write_points(cat.coordinates, path, folder_rows=4096)
    south, north, west, east = geo.bounding_box(PROBE_LAT, PROBE_LON, PROBE_RADIUS_KM)
    near = spatial.read_box(spark, path, south, north, -180.0 if west is None else west, 180.0 if east is None else east)
    return search.search_by_radius(cat.with_tables(coordinates=near), PROBE_LAT, PROBE_LON, PROBE_RADIUS_KM)


# -- streams ------------------------------------------------------------------------------

def _stream_commands(spark, sf_dir):
    return roles.commands({"events": streams.event_stream(spark, sf_dir)})


@register("stream_flags")
def q_stream_flags(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    cmds = _stream_commands(spark, sf_dir).where(F.col("action").isin("VER", "DEL"))
    return streams.stream_flags(spark, cmds, cat.users, cat.restaurants)


@register("stream_comments")
def q_stream_comments(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    cmds = roles.comment_commands({"events": streams.event_stream(spark, sf_dir)})
    return streams.stream_flags(spark, cmds, cat.users, cat.comments)


@register("stream_menu")
def q_stream_menu(spark, sf_dir):
    t, cat = roles.read_tables(spark, sf_dir), roles.bind(spark, sf_dir)
    cmds = roles.menu_commands({**t, "events": streams.event_stream(spark, sf_dir)})
    keys = ("id_restaurant", "id_dish")
    return streams.stream_flags(spark, cmds, cat.users, cat.menu, snap_keys=keys, cmd_keys=keys)


@register("stream_snapshot")
def q_stream_snapshot(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    raw = _stream_commands(spark, sf_dir).where(F.col("action").isin("UPDATE", "VER", "DEL"))
    v = F.col("value")
    raw = raw.select("event_id", "ts", "key", "action", "actor",
                     F.when(v < 1, F.lit(0.0)).otherwise(51.0 + v / 10000.0).alias("coord_x"),
                     (17.0 + v / 10000.0).alias("coord_y"))
    cmds = moderation.location_commands(raw, cat.restaurants, cat.users)
    return streams.stream_locations(spark, cmds, cat.coordinates)


@register("stream_diet_flags")
def q_stream_diet_flags(spark, sf_dir):
    t, cat = roles.read_tables(spark, sf_dir), roles.bind(spark, sf_dir)
    out = streams.stream_diet_flags(spark, cat, roles.menu_commands({**t, "events": streams.event_stream(spark, sf_dir)}))
    return out.select("id", "vegetarian", "vegan")


@register("stream_hours")
def q_stream_hours(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    log = roles.hours_log({"events": streams.event_stream(spark, sf_dir)})
    out = streams.stream_hours(spark, log, cat.hours, cat.restaurants, cat.users)
    return out.withColumn("special", F.to_json("special"))


@register("stream_upsert_comments")
def q_stream_upsert_comments(spark, sf_dir):
    cat = roles.bind(spark, sf_dir)
    subs = roles.comment_submissions({"events": streams.event_stream(spark, sf_dir)})
    return streams.stream_upsert_comments(spark, subs, cat.comments, cat.restaurant_comments, cat.restaurants, cat.users)


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    a = _stream_commands(spark, sf_dir)
    b = _stream_commands(spark, sf_dir)      # a second delivery of every event
    return streams.stream_dedup(spark, a.unionByName(b)).select("event_id", "key", "action")
