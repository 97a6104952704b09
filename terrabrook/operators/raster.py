"""Operators on grids (row, col, v): smoothing and medians in tiles with rims, windows, resampling and connected cells by equal joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .scratch import saved
from .stars import roots
from .tiles import size_of


def _clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))


def gaussian(grid: DataFrame, sigma: float = 1.0, names: Sequence[str] = ("v",), size: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Normalised smoothing of columns: missing cells weigh nothing and are filled from their neighbours; edges reflect, kernel radius int(4 sigma + 0.5).

    Of one grid, or of all that `keys` tell apart, in tiles with rims. size: a row (*keys, h, w) a grid, where grids are larger than their cells. sigma 0 or less: the grid as it is.
    """
    if sigma <= 0:
        return grid.select(*keys, "row", "col", *names)
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return tiles.over_tiles(grid, names, radius, tiles.smoothed([x / sum(kernel) for x in kernel]), keys, size)


def median3x3(grid: DataFrame, keys: Sequence[str] = (), size: DataFrame | None = None) -> DataFrame:
    """The median of the nine cells around; beyond an edge the edge's own cell counts again. Missing cells don't count."""
    return tiles.over_tiles(grid, ["v"], 1, tiles.medians, keys, size)


def window(grid: DataFrame, row: int, col: int, rows: int, cols: int, h: int | None = None, w: int | None = None) -> DataFrame:
    """The part of a grid of rows x cols cells from (row, col), counted from its corner; h, w: read at so many cells, each the one that its centre falls in. Beyond the grid: null."""
    inside = grid.where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    part = inside.select((F.col("row") - row).alias("row"), (F.col("col") - col).alias("col"), "v")
    h, w = h or rows, w or cols
    target = grid.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("long").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    met = target.select("row", "col", F.floor((F.col("row") + 0.5) * rows / h).cast("long").alias("_r"), F.floor((F.col("col") + 0.5) * cols / w).cast("int").alias("_c"))
    return met.join(part.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v"), ["_r", "_c"], "left").select("row", "col", "v")


def upsampled(grid: DataFrame, times: int) -> DataFrame:
    """Every cell as times x times cells."""
    each = lambda axis: F.explode(F.sequence(F.col(axis) * times, F.col(axis) * times + times - 1)).alias(axis)
    return grid.select(each("row"), "col", "v").select("row", each("col"), "v")


def nearest(grid: DataFrame, h: int, w: int) -> DataFrame:
    """The grid at h x w cells, each the cell that its centre falls in."""
    spark = grid.sparkSession
    target = spark.range(h * w).select(F.floor(F.col("id") / w).cast("long").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    met = target.join(F.broadcast(size_of(grid)))
    met = met.select("row", "col", F.floor((F.col("row") + 0.5) * F.col("h") / h).cast("long").alias("_r"), F.floor((F.col("col") + 0.5) * F.col("w") / w).cast("int").alias("_c"))
    return met.join(grid.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v"), ["_r", "_c"], "left").select("row", "col", "v")


def bilinear(grid: DataFrame, h: int, w: int) -> DataFrame:
    """The grid at h x w cells: the four cells around each centre, weighted by nearness; missing ones left out."""
    spark = grid.sparkSession
    target = spark.range(h * w).select(F.floor(F.col("id") / w).cast("long").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    met = target.join(F.broadcast(size_of(grid)))
    y, x = (F.col("row") + 0.5) * F.col("h") / h - 0.5, (F.col("col") + 0.5) * F.col("w") / w - 0.5
    met = met.withColumns({"y": y, "x": x}).withColumns({"y0": F.floor("y"), "x0": F.floor("x")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    met = met.withColumn("o", corner)
    near = lambda p, p0, o: F.when(o == 1, F.col(p) - F.col(p0)).otherwise(1 - (F.col(p) - F.col(p0)))
    met = met.withColumn("k", near("y", "y0", F.col("o.a")) * near("x", "x0", F.col("o.b"))).where("k > 0")
    met = met.withColumns({"_r": _clamped(F.col("y0") + F.col("o.a"), F.col("h")).cast("long"), "_c": _clamped(F.col("x0") + F.col("o.b"), F.col("w")).cast("int")})
    given = grid.where("v is not null").select(F.col("row").alias("_r"), F.col("col").alias("_c"), "v")
    return met.join(given, ["_r", "_c"]).groupBy("row", "col").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("v"))


#: Side of the tiles within which cells are labelled at once.
TILE = 256


def _labelled(tile: pd.DataFrame, diagonal: bool, side: int) -> pd.DataFrame:
    """A tile's cells with the first cell (row-major) that each is connected with inside the tile. Labels hook on to smaller ones and jump, on arrays."""
    r, c = tile["row"].to_numpy() % side, tile["col"].to_numpy() % side
    at = np.full((side + 2, side + 2), -1, np.int64)
    at[r + 1, c + 1] = np.arange(len(tile))
    place, z = np.argsort(np.argsort(r * side + c)), tile["z"].to_numpy()
    here, there = [], []
    for a, b in ((0, 1), (1, 0), (1, 1), (1, -1)) if diagonal else ((0, 1), (1, 0)):
        other = at[r + 1 + a, c + 1 + b]
        same = np.flatnonzero((other >= 0) & (z[other] == z))
        here.append(place[same])
        there.append(place[other[same]])
    u, v, label = np.concatenate(here), np.concatenate(there), np.arange(len(tile))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (u, v, label[u], label[v]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    first = np.argsort(place)[label[place]]
    return tile.assign(r0=tile["row"].to_numpy()[first], c0=tile["col"].to_numpy()[first].astype(np.int64))


def components(cells: DataFrame, diagonal: bool) -> DataFrame:
    """(grid, row, col, z, label): connected cells of equal z within a grid, labelled by their first cell (row-major). Cells are labelled within tiles of TILE x TILE; labels of
    different tiles are linked by an equal join of the cells along the tiles' rims, and the links solved by joins and aggregates."""
    side = TILE
    tile = [F.floor(F.col(x) / side).alias(f"_{x}") for x in ("row", "col")]
    kinds = dict(cells.dtypes)
    shape = f"grid {kinds['grid']}, row {kinds['row']}, col {kinds['col']}, z {kinds['z']}, r0 long, c0 long"
    marked = saved(cells.select("grid", "row", "col", "z").groupBy("grid", *tile).applyInPandas(lambda pdf: _labelled(pdf, diagonal, side), shape), "tiles")
    near = lambda axis: F.pmod(F.col(axis), F.lit(side))
    rim = marked.where(near("row").isin(0, side - 1) | near("col").isin(0, side - 1)).select("grid", "z", "row", "col", F.struct("grid", "z", "r0", "c0").alias("u"))
    reach = F.array(*(F.struct(F.lit(d).alias("d")) for d in ((-1, 0, 1) if diagonal else (0,))))
    above = F.when(near("row") == 0, F.transform(reach, lambda o: F.struct(F.lit(-1).alias("a"), o["d"].alias("b"))))
    before = F.when(near("col") == 0, F.transform(reach, lambda o: F.struct(o["d"].alias("a"), F.lit(-1).alias("b"))))
    asked = rim.withColumn("o", F.explode(F.concat(F.coalesce(above, F.array()), F.coalesce(before, F.array()))))
    asked = asked.select("grid", "z", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "u")
    links = asked.join(rim.withColumnRenamed("u", "v"), ["grid", "z", "row", "col"]).where("u <> v").select("u", "v")
    found = roots(links).select("node.grid", "node.z", "node.r0", "node.c0", F.struct("root.r0", "root.c0").alias("_label"))
    met = marked.join(found, ["grid", "z", "r0", "c0"], "left")
    return met.select("grid", "row", "col", "z", F.coalesce("_label", F.struct("r0", "c0")).alias("label"))


def dissolved(cells: DataFrame, least: int) -> DataFrame:
    """Patches (8-connected, zone above 0) of fewer than `least` cells take the commonest other zone in their bounding box and one cell around it, the
    smallest of equals; without one, and all other patches, they stay. One pass: all look at the zones as they were. Tables of cells, whose files are small beside their rows, aren't broadcast."""
    zones = cells.where("z > 0")
    labels = saved(components(zones, True), "labels")
    patch = labels.groupBy("grid", "z", "label").agg(F.count("*").alias("n"), F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))
    small = patch.where(F.col("n") < least)
    box = small.select("grid", F.col("z").alias("own"), "label", F.explode(F.sequence(F.col("r1") - 1, F.col("r2") + 1)).alias("row"), "c1", "c2")
    box = box.select("grid", "own", "label", "row", F.explode(F.sequence((F.col("c1") - 1).cast("int"), (F.col("c2") + 1).cast("int"))).alias("col"))
    votes = box.join(zones.hint("merge"), ["grid", "row", "col"]).where("z <> own").groupBy("grid", "own", "label", "z").agg(F.count("*").alias("k"))
    winner = votes.groupBy("grid", F.col("own").alias("z"), "label").agg(F.max_by("z", F.struct("k", -F.col("z"))).alias("_new"))
    moved = labels.hint("merge").join(winner, ["grid", "z", "label"]).select("grid", "row", "col", "_new")
    return cells.hint("merge").join(moved, ["grid", "row", "col"], "left").select("grid", "row", "col", F.coalesce("_new", "z").alias("z"))


def tight_extent(grid: DataFrame) -> DataFrame:
    return grid.where("v is not null").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))
