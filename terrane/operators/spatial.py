"""Boxes, grids and projections by arithmetic on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bbox_overlap(a: DataFrame, b: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose boxes (minLat, maxLat, minLon, maxLon) overlap or touch.

    Grids have levels, with cells twice as wide from one to the next. A box belongs to
    the level whose cells are its size at least, so it covers four cells at most there
    and on any higher level. A pair meets on the higher of its two levels, and counts in
    the first cell that both cover: the join is a hash join without duplicates, and a
    wide box costs no more than a narrow one. Columns of ``b`` get the prefix b_. Boxes
    with null, infinite or reversed sides overlap with nothing.
    """

    def levelled(df: DataFrame, p: str) -> DataFrame:
        lo_y, hi_y, lo_x, hi_x = (F.col(f"{p}{c}") for c in ("minLat", "maxLat", "minLon", "maxLon"))
        wide = F.greatest(hi_y - lo_y, hi_x - lo_x)
        sound = df.where((lo_y <= hi_y) & (lo_x <= hi_x) & (F.abs(lo_y) < 1e300) & (F.abs(hi_y) < 1e300) & (F.abs(lo_x) < 1e300) & (F.abs(hi_x) < 1e300))
        return sound.withColumn(f"{p}__own", F.when(wide > cell, F.ceil(F.log2(wide / cell))).otherwise(0).cast("int"))

    def cells(df: DataFrame, p: str, top: int) -> DataFrame:
        size = F.lit(2.0) ** F.col("__level") * cell
        span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{p}min{c}") / size), F.floor(F.col(f"{p}max{c}") / size)))
        return df.withColumn("__level", F.explode(F.sequence(F.col(f"{p}__own"), F.lit(top)))).withColumn("cy", span("Lat")).withColumn("cx", span("Lon"))

    left, right = levelled(a, ""), levelled(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]), "b_")
    top = max(left.agg(F.max("__own")).first()[0] or 0, right.agg(F.max("b___own")).first()[0] or 0)
    met = cells(left, "", top).join(cells(right, "b_", top), ["__level", "cy", "cx"])
    over = (F.col("maxLat") >= F.col("b_minLat")) & (F.col("b_maxLat") >= F.col("minLat")) & (F.col("maxLon") >= F.col("b_minLon")) & (F.col("b_maxLon") >= F.col("minLon"))
    size = F.lit(2.0) ** F.col("__level") * cell
    first = (F.col("cy") == F.floor(F.greatest("minLat", "b_minLat") / size)) & (F.col("cx") == F.floor(F.greatest("minLon", "b_minLon") / size))
    here = F.col("__level") == F.greatest("__own", "b___own")
    return met.where(here & over & first).drop("cy", "cx", "__level", "__own", "b___own")


def grid_coords(pix: Column, width: int, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Cell centres of a row-major index."""
    return x0 + (pix % width + 0.5) * dx, y0 + (F.floor(pix / width) + 0.5) * dy


def utm(lat: Column, lon: Column, zone: int = 43, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing (WGS 84) of degrees, by the usual series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = a / F.sqrt(1 - e2 * s * s)
    tt, cc, aa = t * t, ep2 * c * c, c * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = aa * aa
    east = k0 * n * (aa + (1 - tt + cc) * aa * a2 / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * aa * a2 * a2 / 120) + 500000
    north = k0 * (m + n * t * (a2 / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * a2 * a2 / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * a2 * a2 * a2 / 720))
    return east, north + 10_000_000 if south else north


def from_utm(east: Column, north: Column, zone: int = 43, south: bool = False) -> tuple[Column, Column]:
    """Degrees (latitude, longitude) of easting and northing, by the usual series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (north - 10_000_000 if south else north) / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = (
        mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    )
    s, c, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    cc, tt, w = ep2 * c * c, tan * tan, 1 - e2 * s * s
    n, r = a / F.sqrt(w), a * (1 - e2) / (w * F.sqrt(w))
    d = (east - 500000) / (n * k0)
    d2 = d * d
    lat = foot - n * tan / r * (d2 / 2 - (5 + 3 * tt + 10 * cc - 4 * cc * cc - 9 * ep2) * d2 * d2 / 24 + (61 + 90 * tt + 298 * cc + 45 * tt * tt - 252 * ep2 - 3 * cc * cc) * d2 * d2 * d2 / 720)
    lon = (d - (1 + 2 * tt + cc) * d * d2 / 6 + (5 - 2 * cc + 28 * tt - 3 * cc * cc + 8 * ep2 + 24 * tt * tt) * d * d2 * d2 / 120) / c
    return F.degrees(lat), F.degrees(lon) + (zone * 6 - 183)


def inside(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Is a point inside a ring of corners? Even-odd rule, as one expression for the scan."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            out = out != crosses
    return out


def clip(df: DataFrame, x: Column, y: Column, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows with their centre in (minX, minY, maxX, maxY)."""
    return df.where((x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3]))


def resample(df: DataFrame, keys: list[str], row: str, col: str, value: str, factor: float) -> DataFrame:
    """Bilinear values on a grid ``factor`` times as fine: each cell gives its share to the new cells around it.

    keys, row, col, value of the new grid. A weighted aggregation of up to four
    neighbours; where some are missing, the others' weights are scaled up.
    """
    reach = math.ceil(factor) + 1
    centre = lambda i: (F.col(i) + 0.5) * factor - 0.5
    near = lambda i: F.explode(F.filter(F.sequence(F.floor(centre(i)) - reach, F.floor(centre(i)) + reach), lambda k: (k >= 0) & (F.abs(k - centre(i)) < factor)))
    spread = df.where(F.col(value).isNotNull()).withColumn("__r", near(row)).withColumn("__c", near(col))
    weight = (1 - F.abs(F.col("__r") - centre(row)) / factor) * (1 - F.abs(F.col("__c") - centre(col)) / factor)
    out = spread.withColumn("__w", weight).groupBy(*keys, F.col("__r").alias("new_row"), F.col("__c").alias("new_col"))
    return out.agg(F.round(F.sum(F.col(value) * F.col("__w")) / F.sum("__w"), 6).alias(value))


def extent_json(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.to_json(F.struct(minx.alias("minX"), miny.alias("minY"), maxx.alias("maxX"), maxy.alias("maxY")))
