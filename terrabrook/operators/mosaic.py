"""Mosaics and temporal fills of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_valid(pixels: DataFrame, cell: Sequence[str], bands: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each cell the first row, in a total order, whose bands are all there."""
    whole = pixels.dropna(subset=list(bands))
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    return whole.withColumn("_n", n).where("_n = 1").drop("_n")


def temporal_median(pixels: DataFrame, cell: Sequence[str], bands: Sequence[str], order: Sequence[str], most: int = 6) -> DataFrame:
    """Per cell the median of each band over its first `most` rows; missing values are left out."""
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    few = pixels.withColumn("_n", n).where(F.col("_n") <= most)
    return few.groupBy(*cell).agg(*(F.median(b).alias(b) for b in bands))


def first_and_median(pixels: DataFrame, cell: Sequence[str], bands: Sequence[str], order: Sequence[str], kept: Sequence[str] = (), most: int = 6) -> DataFrame:
    """One row a cell, from one shuffle: bands and `kept` of its first row with all bands, and `_fill`, the medians of its first `most` rows."""
    whole = F.lit(True)
    for b in bands:
        whole &= F.col(b).isNotNull()
    n = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    rows = pixels.select(*cell, *dict.fromkeys([*bands, *kept]), n.alias("_n"), whole.alias("_whole"))
    first = F.min_by(F.struct(*dict.fromkeys([*bands, *kept])), F.when(F.col("_whole"), F.col("_n")))
    medians = F.struct(*(F.median(F.when(F.col("_n") <= most, F.col(b))).alias(b) for b in bands))
    return rows.groupBy(*cell).agg(first.alias("_first"), medians.alias("_fill")).select(*cell, "_first.*", "_fill")


def filled_if_sparse(cells: DataFrame, bands: Sequence[str], least: float = 0.7) -> DataFrame:
    """first_and_median()'s cells, those without all bands taking all of `_fill` if it is whole; only if the share of cells with all bands is below `least`. One lazy plan."""
    have, fill = F.lit(True), F.lit(True)
    for b in bands:
        have, fill = have & F.col(b).isNotNull(), fill & F.col(f"_fill.{b}").isNotNull()
    share = cells.agg((F.count_if(have) / F.greatest(F.count("*"), F.lit(1))).alias("share"))
    use = ~have & fill & (share.scalar() < least)
    return cells.withColumns({b: F.when(use, F.col(f"_fill.{b}")).otherwise(F.col(b)) for b in bands}).drop("_fill")


def filled(base: DataFrame, fill: DataFrame, cell: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """base with missing bands from fill where all of a cell's bands are there."""
    whole = fill.dropna(subset=list(bands)).select(*cell, *(F.col(b).alias(f"_{b}") for b in bands))
    met = base.join(whole, list(cell), "left")
    return met.withColumns({b: F.coalesce(b, f"_{b}") for b in bands}).drop(*(f"_{b}" for b in bands))


def fill_if_sparse(base: DataFrame, fill: DataFrame, cell: Sequence[str], bands: Sequence[str], least: float = 0.7) -> DataFrame:
    """filled(), if the share of base's cells with all bands is below `least`; one lazy plan, whatever the share is."""
    whole = F.lit(True)
    for b in bands:
        whole &= F.col(b).isNotNull()
    share = base.agg((F.count_if(whole) / F.greatest(F.count("*"), F.lit(1))).alias("share"))
    use = fill.where(share.scalar() < least)
    return filled(base, use, cell, bands)
