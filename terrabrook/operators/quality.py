"""Making band values sound: missing values, scaling, radar power, cloud masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """v, or null where it is NaN or infinite."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


Clip = Callable[[DataFrame], DataFrame]


def _with_largest(pixels: DataFrame, values: dict[str, Column], by: Sequence[str], clip: Clip | None = None) -> DataFrame:
    """pixels with `_max`, the largest of each of `values` in its array (of a scene): a small aggregate that is joined, so no scene's pixels come together in a task.
    clip: keeps some of the pixels, before the join; the largest values are those of all."""
    largest = pixels.groupBy(*by).agg(F.struct(*(F.max(v).alias(n) for n, v in values.items())).alias("_max"))
    return (clip(pixels) if clip else pixels).join(largest, list(by), "left")


def _reflectance(b: str, above: float = 1.5) -> Column:
    return F.when(F.col(f"_max.{b}") > above, F.col(b) * 1e-4).otherwise(F.col(b))


def _positive(b: str) -> Column:
    return F.when(finite(F.col(b)) > 0, F.col(b))


def _power(b: str) -> Column:
    v = _positive(b)
    return F.when(F.col(f"_max.{b}") <= 2.0, v).otherwise(v * v)


def scaled_reflectance(pixels: DataFrame, bands: Sequence[str], by: Sequence[str], above: float = 1.5) -> DataFrame:
    """Bands times 1e-4 where the array (a scene's band) has a value above the threshold."""
    met = _with_largest(pixels, {b: finite(F.col(b)) for b in bands}, by)
    return met.withColumns({b: _reflectance(b, above) for b in bands}).select(*pixels.columns)


def radar_power(pixels: DataFrame, bands: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Positive values as power: as they are where none of the array is above 2, else squared."""
    met = _with_largest(pixels, {b: _positive(b) for b in bands}, by)
    return met.withColumns({b: _power(b) for b in bands}).select(*pixels.columns)


def stacked(pixels: DataFrame, bands: Sequence[str], by: Sequence[str], clip: Clip | None = None) -> DataFrame:
    """Tiles as an analysis reads them: finite values, optical bands as reflectance, radar bands as positive power; tiles without any value in any band are left out. clip: which pixels of them."""
    radar = [b for b in bands if b in ("vv", "vh")]
    met = _with_largest(pixels, {b: _positive(b) if b in radar else finite(F.col(b)) for b in bands}, by, clip)
    met = met.where(F.coalesce(*(F.col(f"_max.{b}") for b in bands)).isNotNull())
    return met.withColumns({b: _power(b) if b in radar else finite(_reflectance(b)) for b in bands}).select(*pixels.columns)


def stacked_for(pixels: DataFrame, groups: dict[str, Sequence[str]], by: Sequence[str], clip: Clip | None = None) -> DataFrame:
    """stacked() for several sets of bands in one pass: tiles stay, and `_has`, a struct of the sets' names, says for which of them a tile would."""
    bands = list(dict.fromkeys(b for g in groups.values() for b in g))
    radar = [b for b in bands if b in ("vv", "vh")]
    met = _with_largest(pixels, {b: _positive(b) if b in radar else finite(F.col(b)) for b in bands}, by, clip)
    has = F.struct(*(F.coalesce(*(F.col(f"_max.{b}") for b in g)).isNotNull().alias(n) for n, g in groups.items()))
    return met.withColumns({b: _power(b) if b in radar else finite(_reflectance(b)) for b in bands} | {"_has": has}).select(*pixels.columns, "_has")


def mask_clouds(pixels: DataFrame, columns: Sequence[str], classes: Sequence[int]) -> DataFrame:
    return pixels.withColumns({c: F.when(F.col("scl").isNull() | ~F.col("scl").isin(*classes), F.col(c)) for c in columns})


def valid_fraction(pixels: DataFrame, column: str, by: str) -> DataFrame:
    return pixels.groupBy(by).agg((F.count(column) / F.greatest(F.count("*"), F.lit(1))).alias("valid_fraction"))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))
