"""Warping grids between UTM zones: every target cell looks up where it lies in the source.

The target's cells are projected back into the source's zone by column expressions, which gives each a place (y, x) among the source's cells, and with it the source
tile that holds it. Source tiles have a rim of one cell, so a cell and its neighbours are in one tile: one shuffle of the source and of the target by tile, then a
lookup on arrays. Places outside the source are null, missing cells weigh nothing, and at the source's edge the edge's own cells count again.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiles
from .grid import from_utm, to_utm


class Frame(NamedTuple):
    """Where a grid lies: its upper left corner in a UTM zone, metres a cell, cells."""

    x0: float
    y0: float
    res_m: float
    epsg: int
    h: int
    w: int


def places(row: Column, col: Column, target: Frame, source: Frame) -> Column:
    """An array of one (y, x): where the centre of a target cell lies among the source's cells, whose centres are at whole numbers. Each step is bound to a variable, so none is worked out twice."""
    point = F.array(F.struct((target.x0 + (col + 0.5) * target.res_m).alias("a"), (target.y0 - (row + 0.5) * target.res_m).alias("b")))
    pair = lambda ab: F.struct(ab[0].alias("a"), ab[1].alias("b"))
    if target.epsg != source.epsg:
        point = F.transform(point, lambda p: pair(from_utm(p["a"], p["b"], target.epsg)))
        point = F.transform(point, lambda p: pair(to_utm(p["a"], p["b"], source.epsg)))
    return F.transform(point, lambda p: F.struct(((source.y0 - p["b"]) / source.res_m - 0.5).alias("y"), ((p["a"] - source.x0) / source.res_m - 0.5).alias("x")))


def _sampled(table: pa.Table, nearest: bool) -> pa.Table:
    y, x = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_x"))
    asked = ~np.isnan(y)
    kept = table.filter(pa.array(asked))
    out = kept.drop_columns(["_y", "_x", "_r", "_c", "_h", "_w", "_row", "_col", "v"])
    if not kept.num_rows:
        return out.append_column("v", pa.array([], pa.float64()))
    r, c, v = (table.column(n).to_numpy(zero_copy_only=False)[~asked] for n in ("_row", "_col", "v"))
    h, w = kept.column("_h")[0].as_py(), kept.column("_w")[0].as_py()
    y, x = y[asked], x[asked]
    if nearest:
        y, x = np.floor(y + 0.5), np.floor(x + 0.5)
    y0, x0 = np.floor(y), np.floor(x)
    low, left = int(y0.min()) - 1, int(x0.min()) - 1
    grid = np.full((int(y0.max()) - low + 3, int(x0.max()) - left + 3), np.nan)
    r, c = r.astype(np.int64) - low, c.astype(np.int64) - left
    inside = (r >= 0) & (r < grid.shape[0]) & (c >= 0) & (c < grid.shape[1])
    grid[r[inside], c[inside]] = v[inside]
    total, weight = np.zeros(len(y)), np.zeros(len(y))
    for a in (0, 1):
        for b in (0, 1):
            k = np.where(a, y - y0, 1 - (y - y0)) * np.where(b, x - x0, 1 - (x - x0))
            near = grid[np.clip(y0 + a, 0, h - 1).astype(np.int64) - low, np.clip(x0 + b, 0, w - 1).astype(np.int64) - left]
            there = ~np.isnan(near) & (k > 0)
            total += np.where(there, k * np.where(there, near, 0.0), 0.0)
            weight += np.where(there, k, 0.0)
    return out.append_column("v", pa.array(np.where(weight > 0, total / np.maximum(weight, 1e-300), np.nan), pa.float64(), from_pandas=True))


def warped(cells: DataFrame, source: Frame, target: Frame, keys: Sequence[str] = (), nearest: bool = False) -> DataFrame:
    """(*keys, row, col, v) of the target's cells that lie in the source: cells (*keys, row, col, v) of one or more grids of the same frame, bilinear or nearest."""
    side, spark = tiles.SIDE, cells.sparkSession
    size = cells.select(*keys).distinct().withColumns({"h": F.lit(source.h).cast("long"), "w": F.lit(source.w).cast("long")}) if keys else spark.range(1).select(F.lit(source.h).cast("long").alias("h"), F.lit(source.w).cast("long").alias("w"))
    given = tiles.haloed(cells.where((F.col("row") < source.h) & (F.col("col") < source.w)), ["v"], 1, keys, size, side).withColumnsRenamed({"row": "_row", "col": "_col"})
    grid = spark.range(target.h * target.w).select(F.floor(F.col("id") / target.w).alias("row"), (F.col("id") % target.w).cast("int").alias("col"))
    grid = grid.select("row", "col", F.explode(places(F.col("row"), F.col("col"), target, source)).alias("_p")).select("row", "col", F.col("_p.y").alias("_y"), F.col("_p.x").alias("_x"))
    grid = grid.where((F.col("_y") >= -0.5) & (F.col("_y") < source.h - 0.5) & (F.col("_x") >= -0.5) & (F.col("_x") < source.w - 0.5))
    tile = lambda p, n: F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(p))) / side)
    grid = grid.withColumns({"_r": tile("_y", source.h), "_c": tile("_x", source.w), "_h": F.lit(source.h).cast("long"), "_w": F.lit(source.w).cast("long")})
    if keys:
        kinds = given.select(*keys, "_r", "_c").distinct()  # a grid asks only the tiles that it has
        grid = grid.join(kinds, ["_r", "_c"])
    shape = [*((k, dict(cells.dtypes)[k]) for k in keys), ("row", "bigint"), ("col", "int"), ("v", "double")]
    both = given.unionByName(grid, allowMissingColumns=True)
    return both.groupBy(*keys, "_r", "_c").applyInArrow(lambda t: _sampled(t, nearest).select([n for n, _ in shape]), ", ".join(f"`{n}` {t}" for n, t in shape))
