"""Grids, projections and polygons."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The WGS84 ellipsoid and the scale and offsets of UTM.
A, FLATTENING, K0, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def _series() -> tuple[float, list[float], list[float]]:
    """Krueger's rectifying radius and the coefficients of his series to the fourth order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    ahead = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, ahead, back


def zone_of(epsg: int) -> tuple[int, bool]:
    """(UTM zone, south) of 326xx and 327xx."""
    if epsg // 100 not in (326, 327) or not 1 <= epsg % 100 <= 60:
        raise ValueError(f"not a UTM code: {epsg}")
    return epsg % 100, epsg // 100 == 327


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    zone, south = zone_of(epsg)
    radius, ahead, _ = _series()
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ahead, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + K0 * radius * x, K0 * radius * y + (FALSE_NORTH if south else 0.0)


def from_utm(east: Column, north: Column, epsg: int) -> tuple[Column, Column]:
    """(lon, lat)."""
    zone, south = zone_of(epsg)
    radius, _, back = _series()
    e2 = FLATTENING * (2 - FLATTENING)
    xi, eta = (north - (FALSE_NORTH if south else 0.0)) / (K0 * radius), (east - FALSE_EAST) / (K0 * radius)
    x, y = eta, xi
    for j, b in enumerate(back, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    e = math.sqrt(e2)
    phi = chi
    for _ in range(5):  # the conformal latitude is undone by iterating
        phi = F.asin(F.tanh(F.atanh(F.sin(chi)) + e * F.atanh(e * F.sin(phi))))
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183), F.degrees(phi)


def corner_lonlat(row: Column, col: Column, x0: float, y0: float, res_m: float, epsg: int) -> tuple[Column, Column]:
    """(lon, lat), rounded to 7 places, of a corner of cells; (x0, y0) is the grid's upper left corner in the UTM zone."""
    lon, lat = from_utm(F.lit(x0) + col * res_m, F.lit(y0) - row * res_m, epsg)
    return F.round(lon, 7), F.round(lat, 7)


def adaptive_grid(dx: Column, dy: Column, native: float = 10.0) -> Column:
    """(res_m, width, height) of a box in metres: a long side of 600 to 1200 cells where resolution allows."""
    long_ = F.greatest(dx, dy)
    res = F.greatest(F.lit(0.5), F.least(F.lit(40.0), F.least(F.greatest(long_ / 1200, F.lit(native / 2)), long_ / 600)))
    side = lambda d: F.greatest(F.lit(1), F.ceil(d / res)).cast("int")
    return F.struct(res.alias("res_m"), side(dx).alias("width"), side(dy).alias("height"))


def native_grid(dx: Column, dy: Column, native: float = 10.0, most: int = 2000) -> Column:
    """The sensor's own resolution, coarser only where a side would pass `most` cells."""
    long_ = F.greatest(dx, dy)
    res = F.when(long_ / native > most, long_ / most).otherwise(F.lit(native))
    side = lambda d: F.greatest(F.lit(1), F.ceil(d / res)).cast("int")
    return F.struct(res.alias("res_m"), side(dx).alias("width"), side(dy).alias("height"))


def capped_grid(dx: Column, dy: Column, native: float = 10.0, longest: int = 1200) -> Column:
    """(res_m, width, height) of a box in metres: a long side of `longest` cells, within 0.5 to 40 m and not finer than half the sensor's resolution."""
    res = F.greatest(F.least(F.greatest(F.greatest(dx, dy) / longest, F.lit(0.5)), F.lit(40.0)), F.lit(native / 2))
    side = lambda d: F.greatest(F.lit(1), F.ceil(d / res)).cast("int")
    return F.struct(res.alias("res_m"), side(dx).alias("width"), side(dy).alias("height"))


def edges_of(rings: Sequence[Sequence[tuple[float, float]]]) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b]


def inside(x: Column, y: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a point lies in a polygon, by the parity of the edges that a ray to the right crosses. A polygon is a parameter, so this is one expression."""
    crossed = F.lit(0)
    for x1, y1, x2, y2 in edges_of(rings):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossed = crossed + F.when(spans & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossed % 2 == 1


def meets(points: Column, rings: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """Whether a polygon given as an array of points (x, y) and one given as rings have a point in common."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % n).alias("b")))
    sides = F.array(*(F.struct(F.struct(F.lit(x1).alias("x"), F.lit(y1).alias("y")).alias("a"), F.struct(F.lit(x2).alias("x"), F.lit(y2).alias("y")).alias("b")) for x1, y1, x2, y2 in edges_of(rings)))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    apart = lambda e, f, k: (F.greatest(e["a"][k], e["b"][k]) < F.least(f["a"][k], f["b"][k])) | (F.greatest(f["a"][k], f["b"][k]) < F.least(e["a"][k], e["b"][k]))
    cross = lambda e, f: ~apart(e, f, "x") & ~apart(e, f, "y") & (turn(e["a"], e["b"], f["a"]) * turn(e["a"], e["b"], f["b"]) <= 0) & (turn(f["a"], f["b"], e["a"]) * turn(f["a"], f["b"], e["b"]) <= 0)
    x, y = rings[0][0]
    spans = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (F.lit(x) < (e["b"]["x"] - e["a"]["x"]) * (F.lit(y) - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    first = F.get(points, F.lit(0))
    return F.exists(edges, lambda e: F.exists(sides, lambda f: cross(e, f))) | (F.size(spans) % 2 == 1) | inside(first["x"], first["y"], rings)


def of_field(cells: DataFrame, rings: Sequence[Sequence[tuple[float, float]]], size: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """The cells whose centre lies in a polygon in shares of the grid's width and height. size: one row (h, w)."""
    met = cells.join(F.broadcast(size.select(F.col("h").alias("_h"), F.col("w").alias("_w"))))
    return met.where(inside((F.col(col) + 0.5) / F.col("_w"), (F.col(row) + 0.5) / F.col("_h"), rings)).drop("_h", "_w")


def rings_of(geojson: Column) -> Column:
    """The rings of a GeoJSON polygon, or of the first of a MultiPolygon, as arrays of points (x, y); also of a Feature's geometry."""
    kind = "struct<type:string,coordinates:string,geometry:struct<type:string,coordinates:string>>"
    read = F.from_json(geojson, kind)
    shape = F.coalesce(read["geometry"], F.struct(read["type"].alias("type"), read["coordinates"].alias("coordinates")))
    rings = F.when(shape["type"] == "MultiPolygon", F.get(F.from_json(shape["coordinates"], "array<array<array<array<double>>>>"), F.lit(0))).otherwise(F.from_json(shape["coordinates"], "array<array<array<double>>>"))
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def reprojected(rings: Column, epsg: int) -> Column:
    """Rings of points (lon, lat) as points (east, north) of a UTM zone."""

    def moved(p: Column) -> Column:
        x, y = to_utm(p["x"], p["y"], epsg)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, moved))


def rasterised(cells: DataFrame, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """The cells whose centre lies in the polygon, which is in grid coordinates (column, row)."""
    flat = [p for ring in rings for p in ring]
    box = F.col("col").between(math.floor(min(p[0] for p in flat)), math.ceil(max(p[0] for p in flat))) & F.col("row").between(math.floor(min(p[1] for p in flat)), math.ceil(max(p[1] for p in flat)))
    return cells.where(box).where(inside(F.col("col") + 0.5, F.col("row") + 0.5, rings))


def bounds_lonlat(corners: DataFrame, epsg: int) -> DataFrame:
    """(west, south, east, north) of corner points (x, y)."""
    lon, lat = from_utm(F.col("x"), F.col("y"), epsg)
    return corners.select(lon.alias("lon"), lat.alias("lat")).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
