"""Great-circle distance and bounding boxes, all as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    """Spherical law of cosines (the reference's formula), acos argument clamped.

    Without the clamp a rounding overshoot above 1 yields NaN and an exact hit
    would vanish from a ``<= r`` filter.
    """
    lat1, lon1, lat2, lon2 = (F.lit(x) if isinstance(x, (int, float)) else x
                              for x in (lat1, lon1, lat2, lon2))
    cos_c = (F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
             * F.cos(F.radians(lon2) - F.radians(lon1))
             + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)))
    return arc_km(cos_c)


def arc_km(cos_c: Column) -> Column:
    """The length of an arc by its angle's cosine, clamped."""
    return F.lit(EARTH_RADIUS_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_c)))


def known_point(lat: Column, lon: Column) -> Column:
    """The reference stores unknown locations as (0,0) and also demands both axes > 0."""
    return (lat > 0) & (lon > 0)


def bounding_box(lat0: float, lon0: float, radius_km: float):
    """Return (lat_lo, lat_hi, lon_lo, lon_hi); lon bounds are None when the
    circle reaches a pole or crosses the antimeridian (latitude box only)."""
    d = radius_km / EARTH_RADIUS_KM
    dlat = math.degrees(d)
    eps = 1e-9
    lat_lo, lat_hi = lat0 - dlat - eps, lat0 + dlat + eps
    if abs(lat0) + dlat >= 90.0:
        return lat_lo, lat_hi, None, None
    sin_ratio = math.sin(d) / math.cos(math.radians(lat0))
    if sin_ratio >= 1.0:
        return lat_lo, lat_hi, None, None
    dlon = math.degrees(math.asin(sin_ratio))
    lon_lo, lon_hi = lon0 - dlon - eps, lon0 + dlon + eps
    if lon_lo < -180.0 or lon_hi > 180.0:
        return lat_lo, lat_hi, None, None
    return lat_lo, lat_hi, lon_lo, lon_hi


def within_box(lat: Column, lon: Column, box) -> Column:
    lat_lo, lat_hi, lon_lo, lon_hi = box
    cond = lat.between(lat_lo, lat_hi)
    if lon_lo is not None:
        cond = cond & lon.between(lon_lo, lon_hi)
    return cond
