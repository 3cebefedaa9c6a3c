"""Radius join for many probe points: grid-cell equi-join + exact filter.

A theta join ``distance(p, t) <= r`` would be a nested loop over all pairs.
Instead both sides get a grid cell whose sides are at least the search radius
in both axes; a probe is replicated into its 3 x 3 neighbourhood (a narrow,
per-row explode) and joined to targets on the cell key, which Spark runs as a
shuffle (or AQE broadcast) hash/sort-merge join.  The exact great-circle test
runs after the join, on sines and cosines taken once a point; a bound on the
angle's cosine goes before the arc cosine.  A crowded cell is a skewed join key that AQE's
skew-join splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions import geo

#: pairs of one neighbourhood that a task tests, up to MOST_TASKS tasks
TASK_PAIRS = 1 << 23
MOST_TASKS = 20_000
#: at most as many targets are broadcast (tens of bytes each)
FEW_TARGETS = 500_000


def _lon_cells(max_abs_lat: Column, d_rad: float) -> Column:
    """Number of longitude cells (each at least as wide as the radius at the
    most polar probe); 1 when a probe circle reaches a pole."""
    lat_reach = F.lit(math.degrees(d_rad)) + max_abs_lat
    return _cells_from_reach(lat_reach, d_rad)


def _cells_from_reach(lat_reach: Column, d_rad: float) -> Column:
    ratio = F.lit(math.sin(d_rad)) / F.cos(F.radians(F.least(lat_reach, F.lit(89.999999))))
    width = F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + F.lit(1e-9)
    n = F.floor(F.lit(360.0) / width)
    return F.when((lat_reach >= 90) | (ratio >= 1), F.lit(1)).otherwise(F.greatest(F.lit(1), n)).cast("long")


def radius_join(probes: DataFrame, targets: DataFrame, radius_km: float,
                probe_id: str = "probe_id", target_id: str = "res_id") -> DataFrame:
    """All (probe, target) pairs within ``radius_km``.

    ``probes`` has (probe_id, lat, lon); ``targets`` has (res_id, lat, lon).
    Returns (probe_id, res_id, distance_km) with the distance rounded to 6
    places. Exact: every pair within the radius shares a 3 x 3 neighbourhood.
    """
    if not radius_km > 0:
        raise ValueError("radius must be positive")
    d_rad = radius_km / geo.EARTH_RADIUS_KM
    lat_cell = math.degrees(d_rad) + 1e-9

    # the cell width depends on one number, the largest |lat| of the probes:
    # a single aggregate job returning one scalar (a scalar subquery would be
    # inlined into every expression that uses it and re-run each time)
    max_abs_lat = probes.agg(F.max(F.abs("lat")).alias("m")).first()["m"]
    n_lon = _lon_cells(F.lit(0.0 if max_abs_lat is None else float(max_abs_lat)), d_rad)

    def with_cells(df, lat, lon, cy, cx):
        df = df.withColumn("_nlon", n_lon)
        return df.select("*", F.floor((F.col(lat) + F.lit(90.0)) / F.lit(lat_cell)).cast("long").alias(cy),
                         F.pmod(F.floor((F.col(lon) + F.lit(180.0)) / (F.lit(360.0) / F.col("_nlon"))).cast("long"),
                                F.col("_nlon")).alias(cx))

    def points(df, id_, side):
        # what the distance needs of a point alone
        df = with_cells(df.select(F.col(id_).alias(f"_{side}id"), "lat", "lon"), "lat", "lon", "cy", "cx")
        return df.select(f"_{side}id", *(f(F.radians("lat")).alias(f"{side}_{name}") for name, f in (("cos", F.cos), ("sin", F.sin))),
                         F.radians("lon").alias(f"{side}_lon"), "cy", "cx", "_nlon")

    t = points(targets, target_id, "t").drop("_nlon")

    offs = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = points(probes, probe_id, "p").withColumnsRenamed({"cy": "py", "cx": "px"})
    # 3 x 3 neighbourhood; array_distinct keeps one copy when there are < 3 lon cells
    neigh = F.array_distinct(F.flatten(F.transform(
        offs, lambda dy: F.transform(
            offs, lambda dx: F.struct((F.col("py") + dy).alias("cy"),
                                      F.pmod(F.col("px") + dx, F.col("_nlon")).alias("cx"))))))
    p = p.select("_pid", "p_cos", "p_sin", "p_lon", F.explode(neigh).alias("c")).select(
        "_pid", "p_cos", "p_sin", "p_lon", "c.cy", "c.cx")

    # the work grows with the pairs of a cell, not with the rows or bytes that Spark deals by
    pairs = (p.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("np")).join(t.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("nt")), ["cy", "cx"])
             .agg(F.sum(F.col("np") * F.col("nt")).alias("pairs")).first()["pairs"] or 0)
    if pairs > TASK_PAIRS:
        n = min(-(-pairs // TASK_PAIRS), MOST_TASKS)
        if t.count() <= FEW_TARGETS:  # a crowded cell is then split by probe
            p, t = p.repartition(n, "_pid", "cy", "cx"), F.broadcast(t)
        else:
            p, t = p.repartition(n, "cy", "cx"), t.repartition(n, "cy", "cx")

    cos_c = F.col("p_cos") * F.col("t_cos") * F.cos(F.col("t_lon") - F.col("p_lon")) + F.col("p_sin") * F.col("t_sin")
    near = cos_c >= math.cos(min(d_rad, math.pi)) - 1e-12  # 1e-12: far above the error of cos_c
    return (p.join(t, ["cy", "cx"]).where(near)
            .select(F.col("_pid").alias(probe_id), F.col("_tid").alias(target_id), geo.arc_km(cos_c).alias("d"))
            .where(F.col("d") <= F.lit(float(radius_km)))
            .select(probe_id, target_id, _six_places(F.col("d")).alias("distance_km")))


def _six_places(d: Column) -> Column:
    """``round(d, 6)`` of distances on a globe; decimals are used only next to a tie."""
    x = d * 1e6
    return F.when(F.abs(x - F.floor(x) - 0.5) > 1e-4, F.floor(x + 0.5) / F.lit(1e6)).otherwise(F.round(d, 6))
