"""Search queries: by name, radius, dish, ingredient, and the combined search."""

from __future__ import annotations

import datetime as _dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.catalog import Catalog
from platewise.functions import geo
from platewise.functions.hours import clock_of, open_after_midnight, open_at
from platewise.functions.text import contains_ci, is_alnum_value, require_term
from platewise.operators.branches import attach_cuisines, menu_branch
from platewise.operators.calendar import attach_current_hours


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def search_by_name(cat: Catalog, term: str, limit: int | None = None,
                   fold_accents: bool = False) -> DataFrame:
    """Verified venues whose name contains ``term`` (case-insensitive; with
    ``fold_accents`` also accent-insensitive), with the non-distinct list of
    their cuisines. Venues without a cuisine drop."""
    require_term(term)
    r = (cat.restaurants.where(F.col("verified") & contains_ci(F.col("name"), term, fold_accents))
         .select(F.col("id").alias("id_restaurant"), "name", "opinion", "address"))
    out = (attach_cuisines(r, cat, distinct=False)
           .select(F.col("id_restaurant").alias("res_id"), F.col("name").alias("res_name"),
                   F.col("opinion").alias("res_score"), "res_cuisines",
                   F.col("address").alias("res_address")))
    return _top(out.orderBy("res_id"), limit)


def _ranked(cat: Catalog, branch: DataFrame, extra: list[str], limit: int | None) -> DataFrame:
    r = (cat.restaurants.where(F.col("verified"))
         .select(F.col("id").alias("id_restaurant"), "name", "opinion"))
    out = (attach_cuisines(r.join(branch, "id_restaurant"), cat)
           .select(F.col("id_restaurant").alias("res_id"),
                   (F.col("n_rows") * F.col("n_cuisine_rows")).cast("long").alias("sort_score"),
                   F.col("name").alias("res_name"), F.col("opinion").alias("res_score"),
                   "res_cuisines", *extra))
    return _top(out.orderBy(F.desc("sort_score"), "res_id"), limit)


def search_by_dish(cat: Catalog, term: str, limit: int | None = None,
                   fold_accents: bool = False) -> DataFrame:
    """Verified venues with verified menu rows whose dish name contains ``term``.

    ``sort_score`` equals the reference's ``count(*)`` over the join product
    (matching menu rows x cuisine rows), computed from branch aggregates.
    """
    require_term(term)
    return _ranked(cat, menu_branch(cat, dish_term=term, fold_accents=fold_accents), ["dish_names"], limit)


def search_by_ingredient(cat: Catalog, term: str, limit: int | None = None,
                         fold_accents: bool = False) -> DataFrame:
    """As :func:`search_by_dish`, matching through dish -> ingredient names."""
    require_term(term)
    branch = menu_branch(cat, ing_term=term, with_ingredients=True, fold_accents=fold_accents)
    return _ranked(cat, branch, ["dish_names", "ing_names"], limit)


def _distance_candidates(cat: Catalog, lat: float, lon: float, radius_km: float,
                         swap_axes: bool = False) -> DataFrame:
    """(id_restaurant, distance_km) within the radius; bounding box first so the
    parquet scan can skip row groups, exact great-circle test after."""
    c = cat.coordinates
    lat_c, lon_c = (F.col("lon"), F.col("lat")) if swap_axes else (F.col("lat"), F.col("lon"))
    box = geo.bounding_box(lat, lon, radius_km)
    dist = geo.great_circle_km(F.lit(float(lat)), F.lit(float(lon)), lat_c, lon_c)
    return (c.where(geo.known_point(F.col("lat"), F.col("lon")) & geo.within_box(lat_c, lon_c, box))
            .select(F.col("id").alias("id_restaurant"), dist.alias("distance"))
            .where(F.col("distance") <= F.lit(float(radius_km))))


def _check_point(lat, lon, radius_km):
    for v in (lat, lon, radius_km):
        if not isinstance(v, (int, float)) or isinstance(v, bool) or math.isnan(v):
            raise ValueError("lat, lon and radius must be numbers")


def search_by_radius(cat: Catalog, lat: float, lon: float, radius_km: float,
                     swap_axes: bool = False, limit: int | None = None) -> DataFrame:
    """Venues (verified or not) with a known location within ``radius_km``,
    distinct cuisines, ascending distance.  ``swap_axes=True`` reproduces the
    reference, whose formula reads the stored latitude as longitude."""
    _check_point(lat, lon, radius_km)
    near = _distance_candidates(cat, lat, lon, radius_km, swap_axes)
    r = cat.restaurants.select(F.col("id").alias("id_restaurant"), "name", "opinion", "address")
    out = (attach_cuisines(near.join(r, "id_restaurant"), cat)
           .select(F.col("id_restaurant").alias("res_id"), F.col("name").alias("res_name"),
                   F.col("opinion").alias("res_score"), "res_cuisines",
                   F.col("address").alias("res_address"),
                   F.round("distance", 6).alias("distance_km")))
    return _top(out.orderBy("distance_km", "res_id"), limit)


def advanced_search(cat: Catalog, res_name: str | None = None, dish_name: str | None = None,
                    ing_name: str | None = None, lat: float | None = None,
                    lon: float | None = None, radius_km: float | None = None,
                    now_open: bool = False, vegetarian: bool = False, vegan: bool = False,
                    as_of: _dt.datetime | None = None, overnight: bool = False,
                    limit: int | None = None, fold_accents: bool = False, swap_axes: bool = False) -> DataFrame:
    """Conjunction of name / dish / ingredient / radius criteria with diet and
    open-now modifiers (the reference's advanced search).

    * empty or missing terms are ignored; a term that is not alphanumeric is
      rejected with ``ValueError``;
    * the radius is used only when lat, lon and radius are all non-zero numbers
      (``swap_axes``: as in :func:`search_by_radius`);
    * modifiers apply only next to a criterion; no criterion raises ``ValueError``;
    * the venue and the menu row must be verified; the venue needs a location
      row, a cuisine and a dish with an ingredient (inner joins);
    * ``hours`` is the effective value on ``as_of``'s date of the venue's
      current hours version (exactly one version, so it does not multiply
      ``sort_score``); ``as_of`` replaces the reference's two clocks.
    """
    terms = {}
    for key, val in (("res_name", res_name), ("dish_name", dish_name), ("ing_name", ing_name)):
        if val is None or val == "":
            continue
        if not is_alnum_value(val):
            raise ValueError(f"{key} must be alphanumeric: {val!r}")
        terms[key] = val

    def _nonzero(v):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and v != 0

    use_radius = _nonzero(lat) and _nonzero(lon) and _nonzero(radius_km)
    if not terms and not use_radius:
        raise ValueError("advanced search needs at least one criterion")
    if as_of is None:
        raise ValueError("as_of is required: the search reports the hours of that day")

    branch = menu_branch(cat, dish_term=terms.get("dish_name"), ing_term=terms.get("ing_name"),
                         with_ingredients=True, vegetarian=vegetarian, vegan=vegan,
                         fold_accents=fold_accents)
    r = cat.restaurants.where(F.col("verified"))
    if "res_name" in terms:
        r = r.where(contains_ci(F.col("name"), terms["res_name"], fold_accents))
    r = r.select(F.col("id").alias("id_restaurant"), "name", "opinion")
    if use_radius:
        loc = _distance_candidates(cat, float(lat), float(lon), float(radius_km), swap_axes)
    else:
        loc = cat.coordinates.select(F.col("id").alias("id_restaurant"), F.lit(None).cast("double").alias("distance"))
    prev = "prev_hours" if (now_open and overnight) else None
    cand = attach_current_hours(r.join(loc, "id_restaurant").join(branch, "id_restaurant"),
                                cat.hours, as_of.date(), prev_col=prev)
    out = attach_cuisines(cand, cat)
    if now_open:
        is_open = open_at(F.col("hours"), clock_of(as_of), overnight)
        if overnight:
            is_open = is_open | open_after_midnight(F.col("prev_hours"), clock_of(as_of))
        out = out.where(is_open)
    cols = [F.col("id_restaurant").alias("res_id"),
            (F.col("n_rows") * F.col("n_cuisine_rows")).cast("long").alias("sort_score"),
            F.col("name").alias("res_name"), F.col("opinion").alias("res_score"), "res_cuisines"]
    if use_radius:
        cols.append(F.round("distance", 6).alias("distance_km"))
    cols += ["hours", "dish_names", F.col("ing_names").alias("ingredient_names")]
    out = out.select(*cols)
    order = (["distance_km"] if use_radius else []) + [F.desc("sort_score"), "res_id"]
    return _top(out.orderBy(*order), limit)
