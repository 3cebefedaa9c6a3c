"""Opening calendars: current version, N-day expansion, open-now, validation."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.catalog import WEEKDAYS
from platewise.functions.hours import (NO_DATA, clock_of, date_key, effective_hours, open_after_midnight,
                                       open_at, special_problem, valid_weekly_value)


def current_hours(hours: DataFrame) -> DataFrame:
    """One current version per venue: verified, not deleted, newest id.

    An aggregate (``max_by``) rather than a window, so a venue with many
    versions is combined map side instead of sorted in one task.
    """
    cols = [c for c in hours.columns if c != "id_restaurant"]
    return (hours.where(F.col("verified") & ~F.col("deleted"))
            .groupBy("id_restaurant")
            .agg(F.max_by(F.struct(*cols), F.col("id")).alias("v"))
            .select("id_restaurant", "v.*"))


def attach_current_hours(venues: DataFrame, hours: DataFrame, day: _dt.date,
                         out_col: str = "hours", prev_col: str | None = None) -> DataFrame:
    """Add the effective hours on ``day`` of each venue's current version
    (NULL when it has none) to ``venues`` (one row per ``id_restaurant``).

    Only the candidates' versions are read into the aggregate: a left join
    and one ``max_by`` per venue, keyed like the caller's other joins.
    """
    d = F.lit(day)
    versions = (hours.where(F.col("verified") & ~F.col("deleted"))
                .select("id_restaurant", F.col("id").alias("_vid"),
                        F.struct(effective_hours(d).alias("h"),
                                 effective_hours(F.date_sub(d, 1)).alias("p")).alias("_h")))
    others = [c for c in venues.columns if c != "id_restaurant"]
    out = (venues.join(versions, "id_restaurant", "left")
           .groupBy("id_restaurant")
           .agg(*[F.any_value(c).alias(c) for c in others],
                F.max_by("_h", F.col("_vid")).alias("_cur")))
    cols = [*venues.columns, F.col("_cur.h").alias(out_col)]
    if prev_col:
        cols.append(F.col("_cur.p").alias(prev_col))
    return out.select(*cols)


def effective_hours_on(hours: DataFrame, day: _dt.date) -> DataFrame:
    """(res_id, day, hours) for every venue with a current version on ``day``."""
    d = F.lit(day)
    return (current_hours(hours)
            .select(F.col("id_restaurant").alias("res_id"), date_key(d).alias("day"),
                    effective_hours(d).alias("hours")))


def weekly_calendar(restaurants: DataFrame, hours: DataFrame, start: _dt.date,
                    days: int = 7) -> DataFrame:
    """``days`` consecutive dates from ``start`` for every venue, one plan.

    The reference issues one SQL statement per venue and day; here the venue
    table is expanded with ``sequence`` (a narrow, per-row operation) and
    left-joined once with the current versions. No version -> 'No data'.
    """
    if days < 1:
        raise ValueError("days must be >= 1")
    cur = current_hours(hours)
    d0 = F.lit(start)
    venues = restaurants.select(F.col("id").alias("id_restaurant"))
    expanded = venues.select(
        "id_restaurant",
        F.posexplode(F.sequence(d0, F.date_add(d0, days - 1))).alias("day_index", "date"))
    return (expanded.join(cur, "id_restaurant", "left")
            .select(F.col("id_restaurant").alias("res_id"), "day_index",
                    date_key(F.col("date")).alias("day"),
                    F.when(F.col("id").isNull(), F.lit(NO_DATA))
                    .otherwise(effective_hours(F.col("date"))).alias("hours")))


def calendar_lookup(restaurants: DataFrame, hours: DataFrame, requests: DataFrame,
                    start: _dt.date, days: int = 7, req_col: str = "id") -> DataFrame:
    """Batch form of the by-id hours lookup: the calendar of the requested
    venues (ids > 0), filtered before the dates are expanded."""
    ids = requests.select(F.col(req_col).alias("id")).where(F.col("id") > 0)
    venues = restaurants.select("id").join(ids, "id", "left_semi")
    return weekly_calendar(venues, hours, start, days)


def open_now(restaurants: DataFrame, hours: DataFrame, as_of: _dt.datetime,
             overnight: bool = False) -> DataFrame:
    """Venues whose current hours on ``as_of``'s date contain its time
    (inclusive).  With ``overnight`` the previous day's overnight range also
    counts up to its closing time."""
    d = F.lit(as_of.date())
    cur = current_hours(hours).select("id_restaurant", effective_hours(d).alias("hours"),
                                      effective_hours(F.date_sub(d, 1)).alias("prev_hours"))
    t = clock_of(as_of)
    is_open = open_at(F.col("hours"), t, overnight)
    if overnight:
        is_open = is_open | open_after_midnight(F.col("prev_hours"), t)
    r = restaurants.select(F.col("id").alias("id_restaurant"), F.col("name").alias("res_name"))
    return (cur.where(is_open)
            .join(r, "id_restaurant")
            .select(F.col("id_restaurant").alias("res_id"), "res_name", "hours"))


def validate_weekly(hours: DataFrame) -> DataFrame:
    """Per hours row: are all seven weekday values well-formed, and which are not."""
    bad = F.array_compact(F.array(*[F.when(~valid_weekly_value(F.col(d)), F.lit(d)) for d in WEEKDAYS]))
    return hours.select("id", "id_restaurant",
                        (F.size(bad) == 0).alias("valid"),
                        F.array_join(bad, ",").alias("bad_days"))


def validate_special(df: DataFrame, special_col: str = "special") -> DataFrame:
    """Adds ``special_valid`` and ``special_problem`` (first failure) for a map column."""
    p = special_problem(F.col(special_col))
    return df.withColumn("special_problem", p).withColumn("special_valid", p.isNull())
