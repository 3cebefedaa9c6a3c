"""Opening-hours expressions (weekday values, dated exceptions, open-now)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from platewise.catalog import WEEKDAYS

# Fixed values that must equal the reference's rules.
CLOSED = "closed"
NO_DATA = "No data"
DATE_KEY_FORMAT = "dd.MM.yyyy"

_TIME_RANGE_JAVA = r"\A\d{2}:\d{2}-\d{2}:\d{2}\z"
_DATE_KEY_JAVA = r"\A\d{2}\.\d{2}\.\d{4}\z"
_CLOCK_JAVA = r"\A(\d{1,2}):(\d{2})\z"


def date_key(d: Column) -> Column:
    """``DD.MM.YYYY`` key of a DATE (no time zone involved)."""
    return F.date_format(d, DATE_KEY_FORMAT)


def weekday_name(d: Column) -> Column:
    """'mon'..'sun' of a DATE, locale-free (``weekday``: 0 = Monday)."""
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(d) + 1)


def weekly_value(d: Column, prefix: str = "") -> Column:
    """The weekday column (mon..sun) of a row that applies on date ``d``."""
    return F.element_at(F.array(*[F.col(prefix + x) for x in WEEKDAYS]), F.weekday(d) + 1)


def effective_hours(d: Column, special: Column = None, prefix: str = "") -> Column:
    """Dated exception first (``closed`` is just a value), else the weekday value."""
    special = F.col(prefix + "special") if special is None else special
    return F.coalesce(F.try_element_at(special, date_key(d)), weekly_value(d, prefix))


def clock_seconds(text: Column) -> Column:
    """``H:MM`` / ``HH:MM`` to seconds of day; NULL when malformed or out of range
    (``STR_TO_DATE(x, '%H:%i')`` gives NULL for 'closed' and '99:99')."""
    h = F.regexp_extract(text, _CLOCK_JAVA, 1)
    m = F.regexp_extract(text, _CLOCK_JAVA, 2)
    ok = text.rlike(_CLOCK_JAVA)
    hi = h.try_cast("int")
    mi = m.try_cast("int")
    return F.when(ok & (hi <= 23) & (mi <= 59), hi * 3600 + mi * 60)


def _range(hours_text: Column):
    return (clock_seconds(F.substring_index(hours_text, "-", 1)),
            clock_seconds(F.substring_index(hours_text, "-", -1)))


def open_at(hours_text: Column, seconds: Column, overnight: bool = False) -> Column:
    """Is ``seconds`` (of day) inside the day's ``open-close`` range? Inclusive.

    By default a range whose close is before its open (22:00-02:00) never
    matches, as in the reference.  With ``overnight=True`` such a range is
    open from its opening time to midnight on its own day; the hours after
    midnight belong to the next day (:func:`open_after_midnight`).
    """
    open_s, close_s = _range(hours_text)
    inside = (open_s <= seconds) & (close_s >= seconds)
    if overnight:
        inside = inside | ((close_s < open_s) & (seconds >= open_s))
    return F.coalesce(inside, F.lit(False))


def open_after_midnight(prev_hours_text: Column, seconds: Column) -> Column:
    """Still open from the previous day's overnight range (e.g. 01:00 inside
    yesterday's 22:00-02:00)?"""
    open_s, close_s = _range(prev_hours_text)
    return F.coalesce((close_s < open_s) & (seconds <= close_s), F.lit(False))


def valid_weekly_value(col: Column) -> Column:
    """``HH:MM-HH:MM`` or 'closed' (format only: '99:99-00:00' passes)."""
    return F.coalesce(col.rlike(_TIME_RANGE_JAVA) | (col == F.lit(CLOSED)), F.lit(False))


def special_problem(special: Column) -> Column:
    """First problem of a special-schedule map, or NULL when valid.

    Every key must be ``DD.MM.YYYY`` and every value 'closed' or a time range.
    """
    msgs = F.transform(
        F.map_entries(special),
        lambda e: F.when(~e["key"].rlike(_DATE_KEY_JAVA),
                         F.concat(F.lit("bad_date:"), e["key"]))
        .when(~F.coalesce(valid_weekly_value(e["value"]), F.lit(False)),
              F.concat(F.lit("bad_range:"), e["key"], F.lit(": "),
                       F.coalesce(e["value"], F.lit("null")))))
    return F.try_element_at(F.filter(msgs, lambda m: m.isNotNull()), F.lit(1))


def clock_of(as_of) -> Column:
    """Seconds of day of a Python ``datetime`` parameter as a literal: the
    wall-clock time the caller means, whatever the session time zone."""
    return F.lit(as_of.hour * 3600 + as_of.minute * 60 + as_of.second)
