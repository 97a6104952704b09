"""Overviews: a grid at half, a quarter and so on of its resolution, so that a coarse read doesn't touch every cell.

A cell of a level holds the sum and the number of the valid cells of level 0 under it, so each level is one aggregate of the level before, a quarter of its size, and means are exact at
every level. Missing values count as cells that aren't valid. Any number of grids, told apart by keys, are rolled up together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def _rolled(level: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The level above: 2 x 2 cells as one."""
    half = [F.floor(F.col(a) / 2).cast(t).alias(a) for a, t in level.dtypes if a in ("row", "col")]
    return level.groupBy(*keys, *half).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(*keys, F.lit(k).alias("level"), "row", "col", "total", "n")


def _base(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    v = F.col("v").cast("double")
    valid = v.isNotNull() & ~F.isnan(v)
    return cells.select(*keys, F.lit(0).alias("level"), "row", "col", F.when(valid, v).otherwise(0.0).alias("total"), valid.cast("long").alias("n"))


def overviews(cells: DataFrame, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, level, row, col, total, n) of levels 0 to `levels` of cells (*keys, row, col, v), as tables."""
    out = level = saved(_base(cells, keys), "level")
    for k in range(1, levels + 1):
        level = saved(_rolled(level, keys, k), "level")
        out = out.unionByName(level)
    return out


def updated(pyramid: DataFrame, changed: DataFrame, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """A pyramid after some cells of level 0 have new values: at each level only those above them are rolled up again."""
    at = [*keys, "row", "col"]
    new = saved(_base(changed, keys), "changed")
    below = pyramid.where("level = 0").join(new.select(*at), at, "left_anti").unionByName(new)
    out, touched = below, new.select(*at)
    for k in range(1, levels + 1):
        parent = [*keys, *(F.floor(F.col(a) / 2).cast(t).alias(a) for a, t in touched.dtypes if a in ("row", "col"))]
        over = [*keys, *(F.floor(F.col(a) / 2).cast(t).alias(f"_{a}") for a, t in touched.dtypes if a in ("row", "col"))]
        touched = saved(touched.select(*parent).distinct(), "touched")
        under = below.select("*", *over[len(keys) :]).join(touched.withColumnsRenamed({"row": "_row", "col": "_col"}), [*keys, "_row", "_col"], "left_semi").drop("_row", "_col")
        again = saved(_rolled(under, keys, k), "level")
        below = pyramid.where(F.col("level") == k).join(again.select(*at), at, "left_anti").unionByName(again)
        out = out.unionByName(below)
    return out


def level_for(h: int, w: int, rows: int, cols: int, most: int) -> int:
    """The coarsest level, up to `most`, that still has a cell for each of rows x cols cells of a grid of h x w."""
    k = 0
    while k < most and 2 ** (k + 1) * rows <= h and 2 ** (k + 1) * cols <= w:
        k += 1
    return k


def decimated(pyramid: DataFrame, h: int, w: int, rows: int, cols: int, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, row, col, v): grids of h x w cells read at rows x cols, each the cell that its centre falls in, at the level that fits: no cell of a finer one is read."""
    k = level_for(h, w, rows, cols, levels)
    high, wide = (h + 2**k - 1) >> k, (w + 2**k - 1) >> k
    spark = pyramid.sparkSession
    pick = lambda n, of, whole: spark.range(n).select(F.col("id").alias("_to"), F.least(F.floor((F.col("id") + 0.5) * whole / n / 2**k), F.lit(of - 1)).alias("_from"))
    kinds = dict(pyramid.dtypes)
    level = pyramid.where(F.col("level") == k)
    met = level.join(pick(rows, high, h).select(F.col("_to").alias("_r"), F.col("_from").cast(kinds["row"]).alias("row")), "row").join(pick(cols, wide, w).select(F.col("_to").alias("_c"), F.col("_from").cast(kinds["col"]).alias("col")), "col")
    return met.select(*keys, F.col("_r").cast("long").alias("row"), F.col("_c").cast("int").alias("col"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("v"))
