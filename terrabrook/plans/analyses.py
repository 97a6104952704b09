"""The service's analyses as lazy plans: availability, index map, time series, nutrient availability, crop health, soil carbon, variable rates.

Each takes pixels, one row for a cell of a scene, and optionally a field: a polygon in shares of the grid. Reading makes bands sound (finite, reflectance or
power) and clips them to the field, so counts and shares are of the field's cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, lookups
from ..functions.indices import index_column, lookup
from ..operators import grid, legend, mosaic, quality, raster, zoning
from ..operators import scenes as choose
from ..operators.scratch import saved

VEGETATION_CLOUD, WATER_CLOUD = 60, 80


@dataclass(frozen=True)
class Field:
    """A polygon in shares of a grid's width and height; row and col name the cells' columns, size is one row (h, w)."""

    rings: Sequence[Sequence[tuple[float, float]]]
    size: DataFrame
    row: str = "row"
    col: str = "col"

    def clip(self, cells: DataFrame) -> DataFrame:
        return grid.of_field(cells, self.rings, self.size, self.row, self.col)


def read(pixels: DataFrame, bands: Sequence[str], field: Field | None = None, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Pixels as analyses read them: sound bands, the field's cells, which are cut out before each meets its scene's largest values."""
    return quality.stacked(pixels, bands, by, field.clip if field else None)


def availability(scenes: DataFrame, start: str, end: str) -> DataFrame:
    return choose.availability(choose.search(scenes, start, end))


def pick_scene(pixels: DataFrame, field: Field | None = None, radar: bool = False, n: int = 1) -> DataFrame:
    """The n scenes that show most of the field."""
    rows = field.clip(pixels) if field else pixels
    return choose.best_scenes(choose.radar_share(rows) if radar else choose.keep_share(rows, lookups.CLOUDS_INDEX), n)


def index_values(pixels: DataFrame, index: str, family: str = "calc", mask: tuple[int, ...] = lookups.CLOUDS_INDEX) -> DataFrame:
    """pixels with `v`, the index, null under clouds."""
    return quality.mask_clouds(pixels.withColumn("v", index_column(index, family)), ["v"], mask)


def index_map(pixels: DataFrame, index: str, cell: list[str], order: list[str], field: Field | None = None) -> DataFrame:
    """The index of a mosaic: per cell the first scene, in order, with all of its bands; a sparse mosaic is filled with medians, then clouds are masked."""
    bands = list(lookup(index).bands)
    cells = mosaic.first_and_median(read(pixels, bands, field), cell, bands, order, ["scl"])
    return index_values(mosaic.filled_if_sparse(cells, bands), index)


def index_legend(values: DataFrame, index: str, res_m: float = 10.0) -> DataFrame:
    return legend.merged_legend(values, "v", index, res_m)


def time_series(pixels: DataFrame, scenes: DataFrame, index: str, family: str, n: int | None = None, field: Field | None = None) -> DataFrame:
    """(day, value, status) of the best scene of each of at most `n` days, by day. pixels.scene_id names scenes.item_id."""
    most = VEGETATION_CLOUD if family == "veg_ts" else WATER_CLOUD
    picked = choose.even_sample(choose.best_per_date(scenes), "day", choose.points(n))
    cloud = choose.known_cloud(F.col("cloud"))
    picked = picked.where(cloud.isNull() | (cloud <= most)).select(F.col("item_id").alias("scene_id"), "day")
    met = read(pixels.join(F.broadcast(picked), "scene_id"), lookup(index, family).bands, field)  # 16 days at most
    mean = met.groupBy("day", "scene_id").agg(F.bround(F.avg(index_column(index, family)), 3).alias("value"))
    daily = mean.groupBy("day").agg(F.avg("value").alias("value")).where("value is not null")
    ladder = classify.vegetation_class if family == "veg_ts" else classify.water_class
    return daily.select("day", "value", ladder(index, F.col("value")).alias("status")).orderBy("day")


def series_summary(series: DataFrame) -> DataFrame:
    return series.agg(F.bround(F.min("value"), 3).alias("least"), F.bround(F.avg("value"), 3).alias("mean"), F.bround(F.max("value"), 3).alias("most"))


#: The index that stands for each nutrient.
NUTRIENT_INDEX = {"N": "NITROGEN", "P": "CCC", "K": "NDMI"}


def nutrient_availability(pixels: DataFrame, field: Field | None = None) -> DataFrame:
    """(nutrient, source_index, score, factor) from the legends of three indices, counted in one pass over the pixels."""
    rows = quality.stacked_for(pixels, {n: lookup(i).bands for n, i in NUTRIENT_INDEX.items()}, ("scene_id",), field.clip if field else None)
    clear = F.col("scl").isNull() | ~F.col("scl").isin(*lookups.CLOUDS_INDEX)
    bins = F.array(*(F.when(F.col(f"_has.{n}"), F.struct(F.lit(n).alias("name"), legend.index_bin(F.when(clear, index_column(i)), i).cast("int").alias("bin"))) for n, i in NUTRIENT_INDEX.items()))
    counted = rows.select(F.explode(bins).alias("b")).where("b is not null").groupBy("b.name", "b.bin").agg(F.count("*").alias("n"))
    scored = legend.scores_of(counted, NUTRIENT_INDEX)
    named = F.create_map(*(F.lit(x) for pair in NUTRIENT_INDEX.items() for x in pair))
    return scored.select(F.col("name").alias("nutrient"), F.element_at(named, F.col("name")).alias("source_index"), "score", "factor")


def crop_health(pixels: DataFrame, days: int | None = None, by: str = "scene_id", field: Field | None = None) -> DataFrame:
    """(by, ndvi, ndre, stage, health, status, stress, cloud_coverage) of every scene, `days` after sowing. Both indices are averaged over the
    clear cells that have all four bands; a scene without such a cell has no health."""
    bands = ["b04", "b05", "b08", "b8a"]
    rows = read(pixels, bands, field, (by,))
    cloudy = F.coalesce(F.col("scl").isin(*lookups.CLOUDS_SHADOW), F.lit(False))
    valid = ~cloudy
    for b in bands:
        valid &= F.col(b).isNotNull()
    means = [F.avg(F.when(valid, index_column(n))).alias(n.lower()) for n in ("NDVI", "NDRE")]
    mean = rows.groupBy(by).agg(*means, F.bround(F.count_if(cloudy) / F.greatest(F.count("*"), F.lit(1)) * 100, 2).alias("cloud_coverage"))
    stage = classify.growth_stage(F.lit(days).cast("int"))
    ranges = F.create_map(*(x for name, (_, a, b) in lookups.STAGES.items() for x in (F.lit(name), F.array(*map(F.lit, (*a, *b))))))
    met = mean.withColumn("stage", stage).withColumn("_r", F.element_at(ranges, F.col("stage")))
    score = 0.6 * classify.stage_score(F.col("ndvi"), F.col("_r")[0], F.col("_r")[1]) + 0.4 * classify.stage_score(F.col("ndre"), F.col("_r")[2], F.col("_r")[3])
    met = met.withColumn("health", F.when(F.col("ndvi").isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")))
    return met.select(by, "ndvi", "ndre", "stage", "health", classify.health_status(F.col("health")).alias("status"), classify.health_stress(F.col("health")).alias("stress"), "cloud_coverage")


def soil_field(pixels: DataFrame, field: Field | None = None, sigma: float = 1.0, row: str = "row", col: str = "col") -> DataFrame:
    """(row, col, six indices, soc, n, p, k) of one scene's cells: five bands are needed, the field's polygon first, clouds and shadows masked, indices smoothed."""
    names = ["ndvi", "ndwi", "savi", "bsi", "swir1", "clay"]
    cells = zoning.soil_indices(read(pixels, zoning.SOIL_BANDS, field))
    cells = quality.mask_clouds(cells, names, lookups.CLOUDS_SHADOW).withColumnsRenamed({row: "row", col: "col"})
    return zoning.soil_maps(raster.gaussian(cells.select("row", "col", *names), sigma, names, field.size if field else None))


def soil_carbon(pixels: DataFrame, field: Field | None = None, sigma: float = 0.0, row: str = "row", col: str = "col") -> tuple[DataFrame, DataFrame]:
    """(statistics, classes) of soil organic carbon; sigma: of the smoothing of the indices of one scene's cells (row, col), none if 0."""
    if sigma > 0:
        maps = soil_field(pixels, field, sigma, row, col)
    else:
        masked = quality.mask_clouds(zoning.soil_indices(read(pixels, zoning.SOIL_BANDS, field)), ["ndvi", "savi", "bsi", "clay"], lookups.CLOUDS_SHADOW)
        maps = zoning.soil_maps(masked)
    return zoning.soc_stats(maps), zoning.soc_classes(maps)


def zone_pipeline(grid: DataFrame, n: int = 5, method: str = "quantile", least_ha: float = 0.05, res_m: float = 10.0) -> DataFrame:
    """(grid, row, col, z): classified, median filtered and dissolved zones of a grid (row, col, v), or of all grids that a column `grid` tells apart, each by its own values; as a table, since
    patches and outlines both ask for them."""
    if method not in ("quantile", "kmeans"):
        raise ValueError("method must be quantile or kmeans")
    keys = ["grid"] if "grid" in grid.columns else []
    zones = (zoning.quantile_zones if method == "quantile" else zoning.kmeans_zones)(grid, "v", n, keys)
    smooth = raster.median3x3(zones.select(*keys, "row", "col", F.col("zone").cast("double").alias("v")), keys)
    number = F.col("grid") if keys else F.lit(0)
    cells = smooth.select(number.cast("long").alias("grid"), F.col("row").cast("long").alias("row"), F.col("col").cast("int").alias("col"), F.col("v").cast("int").alias("z"))
    return saved(raster.dissolved(saved(cells, "cells"), max(1, round(least_ha * lookups.M2_PER_HA / (res_m * res_m)))), "zones")


def variable_rates(grid: DataFrame, nutrient: str, n: int = 5, method: str = "quantile", crop: str | None = None) -> DataFrame:
    """Doses by zone of one nutrient's grid, and the crop's key and demand of it in kg for a tonne of yield; of several grids, which a column `grid` tells apart, by grid and zone."""
    key = lookups.crop_key(crop)
    found = zoning.patches(zone_pipeline(grid, n, method))
    rates = (zoning.rates_by_grid if "grid" in grid.columns else zoning.rates_from_patches)(found, nutrient, n)
    return rates.withColumns({"crop": F.lit(key), "demand_kg_t": F.lit(lookups.CROP_DEMAND[key]["NPK".index(nutrient)])})


def zoning_run(maps: DataFrame, n: int = 5, method: str = "quantile", nutrients: Sequence[str] = ("N", "P", "K")) -> DataFrame:
    """(grid, nutrient, zone, doses) of soil maps (grid, row, col, n, p, k): the zones of all nutrients of all fields in one run, each nutrient of a field being a grid of its own."""
    maps = maps.withColumn("_maps", F.array(*(F.struct(F.lit(k).alias("k"), F.col(x.lower()).alias("v")) for k, x in enumerate(nutrients))))
    each = maps.select("grid", "row", "col", F.explode("_maps").alias("m")).select((F.col("grid") * len(nutrients) + F.col("m.k")).alias("grid"), "row", "col", F.col("m.v").alias("v"))
    found = saved(zoning.patches(zone_pipeline(each, n, method)), "patches")
    out = None
    for k, nutrient in enumerate(nutrients):
        rates = zoning.rates_by_grid(found.where(F.pmod(F.col("grid"), F.lit(len(nutrients))) == k), nutrient, n).withColumn("grid", F.floor(F.col("grid") / len(nutrients)))
        rates = rates.select("grid", F.lit(nutrient).alias("nutrient"), *(c for c in rates.columns if c != "grid"))
        out = rates if out is None else out.unionByName(rates)
    return out
