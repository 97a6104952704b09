"""Neighbourhoods on many grids at once: square tiles with rims copied from their neighbours.

Cells are rows (keys, row, col, values): keys name the grid, so any number of grids of any size passes in one plan. A cell goes to its own tile, and to each
neighbour whose rim it lies in, so the one shuffle has (1 + 2 radius / SIDE)^2 times the cells. A tile is an array in a task: never more than (SIDE + 2 radius)^2
numbers for each value, whatever the grid's size. over_tiles() makes the tiles of a grid that is narrower than SIDE so much taller that they have about as many. Beyond an edge of the grid, cells repeat in reverse. Missing cells and null or NaN values are NaN in the array;
only the given cells come back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a tile's side.
SIDE = 256


def size_of(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, h, w), a row a grid: positions start at 0."""
    return cells.groupBy(*keys).agg((F.max("row") + 1).cast("long").alias("h"), (F.max("col") + 1).cast("long").alias("w"))


def with_size(cells: DataFrame, keys: Sequence[str], size: DataFrame | None, names: tuple[str, str] = ("h", "w")) -> DataFrame:
    """cells with the height and width of their grid; of one grid they are a scalar, of several an equal join brings them."""
    size = size_of(cells, keys) if size is None else size
    if keys:
        return cells.join(size.select(*keys, F.col("h").cast("long").alias(names[0]), F.col("w").cast("long").alias(names[1])), list(keys))
    both = size.select(F.struct(F.col("h").cast("long").alias("h"), F.col("w").cast("long").alias("w"))).scalar()
    return cells.withColumn("_size", both).withColumns({names[0]: F.col("_size.h"), names[1]: F.col("_size.w")}).drop("_size")


def height_of(wide: int, side: int, radius: int) -> int:
    """Rows of a tile of a grid of `wide` columns, so that it has no more numbers with its rim than a square one."""
    return side if wide >= side else (side + 2 * radius) ** 2 // (max(wide, 1) + 2 * radius) - 2 * radius


def _height(wide: Column, side: int, radius: int) -> Column:
    """height_of() as a column."""
    tall = F.floor(F.lit((side + 2 * radius) ** 2) / (F.greatest(wide, F.lit(1)) + 2 * radius)) - 2 * radius
    return F.when(wide >= side, F.lit(side).cast("long")).otherwise(tall)


def _tiles(axis: str, of: str, radius: int, side: Column) -> Column:
    """The tiles that a cell goes to along an axis of `of` cells."""
    at, tile = F.pmod(F.col(axis), side), F.floor(F.col(axis) / side)
    before, behind = (at < radius) & (tile > 0), (at >= side - radius) & ((tile + 1) * side < F.col(of))
    none = F.array().cast("array<bigint>")
    return F.when(~before & ~behind, F.array(tile)).otherwise(F.concat(F.array(tile), F.when(before, F.array(tile - 1)).otherwise(none), F.when(behind, F.array(tile + 1)).otherwise(none)))


def haloed(cells: DataFrame, names: Sequence[str], radius: int, keys: Sequence[str], size: DataFrame | None, side: int, tall: bool = False) -> DataFrame:
    """(*keys, row, col, *names, _h, _w, _r, _c): each cell for every tile (_r, _c) that has it, in its midst or on its rim. tall: tiles have height_of() rows, not `side`."""
    rows = with_size(cells.select(*keys, "row", "col", *(F.col(n).cast("double").alias(n) for n in names)), keys, size, ("_h", "_w"))
    high = _height(F.col("_w"), side, radius) if tall else F.lit(side)
    return rows.withColumn("_r", F.explode(_tiles("row", "_h", radius, high))).withColumn("_c", F.explode(_tiles("col", "_w", radius, F.lit(side))))


def _source(first: int, n: int, of: int) -> np.ndarray:
    """The position that stands at each of n positions from `first` on, where those of an axis of `of` cells repeat in reverse."""
    at = (first + np.arange(n)) % (2 * of)
    return np.where(at < of, at, 2 * of - 1 - at)


def over_tiles(cells: DataFrame, names: Sequence[str], radius: int, run: Callable[[list[np.ndarray], int], list[np.ndarray]], keys: Sequence[str] = (), size: DataFrame | None = None, side: int | None = None) -> DataFrame:
    """(*keys, row, col, *names as doubles): run gets an array for each name, with a rim of `radius`, and returns arrays without it."""
    side = max(side or SIDE, 2 * radius)
    kinds = dict(cells.dtypes)
    rows = haloed(cells, names, radius, keys, size, side, True)
    shape = [*((k, kinds[k]) for k in keys), ("row", kinds["row"]), ("col", kinds["col"]), *((n, "double") for n in names)]

    def tile(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("row", "col"))
        h, w = table.column("_h")[0].as_py(), table.column("_w")[0].as_py()
        own = (r // height_of(w, side, radius) == table.column("_r")[0].as_py()) & (c // side == table.column("_c")[0].as_py())
        kept = table.filter(pa.array(own)).select([n for n, _ in shape])
        if not kept.num_rows:
            return kept
        r0, c0 = int(r[own].min()) - radius, int(c[own].min()) - radius
        high, wide = int(r[own].max()) + radius + 1 - r0, int(c[own].max()) + radius + 1 - c0
        inside = (r >= r0) & (r < r0 + high) & (c >= c0) & (c < c0 + wide)
        at = r[inside] - r0, c[inside] - c0
        rows_, cols = np.clip(_source(r0, high, h) - r0, 0, high - 1), np.clip(_source(c0, wide, w) - c0, 0, wide - 1)
        arrays = []
        for n in names:
            a = np.full((high, wide), np.nan)
            a[at] = table.column(n).to_numpy(zero_copy_only=False)[inside]
            arrays.append(a[rows_][:, cols])
        place = r[own] - r0 - radius, c[own] - c0 - radius
        for n, a in zip(names, run(arrays, radius), strict=True):
            kept = kept.set_column(kept.schema.get_field_index(n), n, pa.array(a[place], pa.float64(), from_pandas=True))
        return kept

    return rows.groupBy(*keys, "_r", "_c").applyInArrow(tile, ", ".join(f"`{n}` {t}" for n, t in shape))


def smoothed(kernel: Sequence[float]) -> Callable[[list[np.ndarray], int], list[np.ndarray]]:
    """For over_tiles: each array folded with a kernel along both axes, over the kernel's weight on what is there."""

    def run(arrays: list[np.ndarray], radius: int) -> list[np.ndarray]:
        out = []
        for a in arrays:
            there = ~np.isnan(a)
            parts = [np.where(there, a, 0.0), there.astype(np.float64)]
            for axis in (1, 0):
                n = parts[0].shape[axis] - 2 * radius
                parts = [sum(x * np.take(p, np.arange(k, k + n), axis) for k, x in enumerate(kernel)) for p in parts]
            out.append(np.where(parts[1] > 1e-6, parts[0] / np.maximum(parts[1], 1e-300), np.nan))
        return out

    return run


def medians(arrays: list[np.ndarray], radius: int) -> list[np.ndarray]:
    """For over_tiles: the median of what is there of the square around each cell."""
    out = []
    for a in arrays:
        high, wide = a.shape[0] - 2 * radius, a.shape[1] - 2 * radius
        near = np.sort(np.stack([a[i : i + high, j : j + wide] for i in range(2 * radius + 1) for j in range(2 * radius + 1)]), 0)
        n = (~np.isnan(near)).sum(0)
        pick = lambda k: np.take_along_axis(near, np.maximum(k, 0)[None], 0)[0]
        out.append(np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, np.nan))
    return out
