"""Points stored along a space-filling curve, read by bounding box.

``write_points`` gives each point its place on a Morton (Z) curve, sorts by it
and stores the points in folders by the curve's leading bits, as many as keep a
folder near ``FOLDER_ROWS``.  A box is a few ranges of the curve: ``read_box``
opens only folders that the ranges touch, and within them the row groups whose
statistics meet the box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bits of each axis
BITS = 16
FOLDER_ROWS = 250_000
MOST_RANGES = 32


def _spread(v: Column) -> Column:
    """A zero bit after each of 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _grid(v: Column, low: float, width: float) -> Column:
    top = (1 << BITS) - 1
    return F.least(F.greatest(F.floor((v - low) / width * (1 << BITS)), F.lit(0)), F.lit(top)).cast("long")


def place(lat: Column, lon: Column) -> Column:
    """The point's place on the curve (0 for points without coordinates)."""
    z = F.shiftleft(_spread(_grid(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_grid(lon, -180.0, 360.0)))
    return F.coalesce(z, F.lit(0).cast("long"))


def write_points(points: DataFrame, path: str, folder_rows: int = FOLDER_ROWS) -> None:
    """Store a table with lat and lon; its other columns stay."""
    folders = max(0, -(-points.count() // folder_rows) - 1).bit_length()
    # the points' own spread of the curve decides the folders: equal shares of the rows, not of the globe
    cuts = points.select(place(F.col("lat"), F.col("lon")).alias("z")).stat.approxQuantile(
        "z", [i / (1 << folders) for i in range(1, 1 << folders)], 0.1 / (1 << folders)) if folders else []
    cuts = sorted({int(c) for c in cuts})
    z = points.withColumn("z", place(F.col("lat"), F.col("lon")))
    after = F.array(*(F.lit(c) for c in cuts)).cast("array<bigint>")
    first = F.coalesce(F.array_max(F.filter(after, lambda c: c <= F.col("z"))), F.lit(0).cast("long"))
    (z.withColumn("folder", first).repartitionByRange("folder", "z").sortWithinPartitions("folder", "z")
     .write.mode("overwrite").partitionBy("folder").parquet(path))


def ranges(south: float, north: float, west: float, east: float) -> list[tuple[int, int]]:
    """Ranges of the curve that cover a box: quarters are cut further as long as there are few, neighbours joined."""
    def grid(v: float, low: float, width: float) -> int:
        return min((1 << BITS) - 1, max(0, int((v - low) / width * (1 << BITS))))

    y0, y1, x0, x1 = grid(south, -90, 180), grid(north, -90, 180), grid(west, -180, 360), grid(east, -180, 360)
    open_, closed = [(0, 0, 0, BITS)], []          # first place, y, x, bits of a square's side
    while open_ and len(open_) + len(closed) < MOST_RANGES:
        z, y, x, bits = open_.pop(0)
        side = 1 << bits
        if y > y1 or x > x1 or y + side <= y0 or x + side <= x0:
            continue
        if bits == 0 or (y0 <= y and y + side - 1 <= y1 and x0 <= x and x + side - 1 <= x1):
            closed.append((z, z + side * side - 1))
            continue
        half = side >> 1
        open_ += [(z + i * half * half, y + half * (i >> 1), x + half * (i & 1), bits - 1) for i in range(4)]
    found = sorted(closed + [(z, z + (1 << 2 * bits) - 1) for z, y, x, bits in open_
                             if not (y > y1 or x > x1 or y + (1 << bits) <= y0 or x + (1 << bits) <= x0)])
    joined: list[tuple[int, int]] = []
    for a, b in found:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def read_box(spark: SparkSession, path: str, south: float, north: float, west: float, east: float) -> DataFrame:
    """The stored points that may lie in the box (whole curve cells: a little more than the box)."""
    whole = spark.read.parquet(path)
    folders: dict[int, str] = {}
    for file in whole.inputFiles():
        folder = file.rsplit("/", 1)[0]
        folders[int(folder.rsplit("=", 1)[1])] = folder
    firsts, wanted = sorted(folders), ranges(south, north, west, east)
    touched = [folders[first] for first, after in zip(firsts, [*firsts[1:], 1 << 2 * BITS], strict=True)
               if any(a < after and b >= first for a, b in wanted)]
    if not touched:
        return whole.limit(0).drop("z", "folder")
    near = F.lit(False)
    for a, b in wanted:
        near |= F.col("z").between(a, b)
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*touched).where(near).drop("z", "folder")
