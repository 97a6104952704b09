"""Bins, legends, areas and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lookups
from ..functions.classify import bin_of, factor
from .quantiles import exact_percentiles
from .raster import gaussian, upsampled


def index_bin(v: Column, index: str) -> Column:
    return bin_of(v, lookups.edges(index), max(1, len(lookups.palette(index)) - 1))


def legend_rows(spark: SparkSession, index: str) -> DataFrame:
    """(bin, color, label) of an index: a fixed table of eleven rows at most."""
    colors, labels = lookups.palette(index), lookups.labels(index)
    labels += [f"bin_{i}" for i in range(len(labels), len(colors))]
    return spark.createDataFrame([(i, c, labels[i]) for i, c in enumerate(colors)], "bin int, color string, label string")


def area_stats(values: DataFrame, v: str, index: str, by: Sequence[str] = (), res_m: float = 10.0) -> DataFrame:
    """(by, bin, label, n, hectares, percent) of the bins that occur. Bin 0 is No Data, whatever the palette calls it."""
    labels = lookups.labels(index)
    names = F.create_map(*(F.lit(x) for i, label in enumerate(labels) for x in (i, "No Data" if i == 0 else label)))
    counted = values.groupBy(*by, index_bin(F.col(v), index).alias("bin")).agg(F.count("*").alias("n"))
    totals = counted.groupBy(*by).agg(F.sum("n").alias("_all")) if by else counted.agg(F.sum("n").alias("_all"))
    met = counted.join(totals, list(by)) if by else counted.join(F.broadcast(totals))
    label = F.coalesce(F.try_element_at(names, F.col("bin")), F.concat(F.lit("bin_"), F.col("bin").cast("string")))
    return met.select(*by, "bin", label.alias("label"), "n", F.bround(F.col("n") * (res_m * res_m) / lookups.M2_PER_HA, 4).alias("hectares"), F.bround(F.col("n") / F.col("_all") * 100, 2).alias("percent"))


def merged_legend(values: DataFrame, v: str, index: str, res_m: float = 10.0) -> DataFrame:
    """(bin, color, label, hectares, percent) of a whole palette; areas are matched by label, so an entry whose label differs has 0."""
    areas = area_stats(values, v, index, (), res_m).select("label", "hectares", "percent")
    met = F.broadcast(legend_rows(values.sparkSession, index)).join(areas, "label", "left")
    return met.select("bin", "color", "label", F.coalesce("hectares", F.lit(0.0)).alias("hectares"), F.coalesce("percent", F.lit(0.0)).alias("percent"))


def stretched(pixels: DataFrame, red: str = "b04", green: str = "b03", blue: str = "b02") -> DataFrame:
    """pixels with r, g, b from 0 to 255: a common stretch between the 2nd and 98th percentile of the luminance, a mild gamma, truncation."""
    ends = exact_percentiles(pixels.select(F.expr(f"0.2126 * {red} + 0.7152 * {green} + 0.0722 * {blue}").alias("v")), "v", (0.02, 0.98))
    lo, hi = ends if ends and ends[1] > ends[0] else (0.0, 0.3)
    tone = lambda c: F.floor(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(F.col(c), F.lit(0.0)) - lo) / (hi - lo))), F.lit(1 / 1.15)) * 255).cast("int")
    return pixels.withColumns({"r": tone(red), "g": tone(green), "b": tone(blue)})


def rgba(color: Column) -> Column:
    """[r, g, b, 255] of a hex colour."""
    return F.array(*(F.conv(F.substring(color, k, 2), 16, 10).cast("int") for k in (2, 4, 6)), F.lit(255))


def darkened(parts: Column, by: float = 0.82) -> Column:
    return F.transform(parts, lambda x, i: F.when(i < 3, F.floor(x * by)).otherwise(x).cast("int"))


def painted(bins: Column, index: str, factor: float = 0.82) -> Column:
    """[r, g, b, a] of a bin: colours a little darker, bin 0 (missing) transparent."""
    colors = F.array(*(darkened(rgba(F.lit(c)), factor) for c in lookups.palette(index)))
    last = len(lookups.palette(index)) - 1
    return F.when(bins > 0, F.get(colors, F.least(bins, F.lit(last)))).otherwise(F.array(*[F.lit(0)] * 4))


def painted_zones(zones: Column, n: int) -> Column:
    """[r, g, b, a] of a zone from 1 to n on the ramp of zones; zone 0 (missing) transparent."""
    colors = F.array(*(rgba(F.lit(c)) for c in lookups.zone_colors(n)))
    return F.when(zones > 0, F.get(colors, zones - 1)).otherwise(F.array(*[F.lit(0)] * 4))


def rendered(grid: DataFrame, index: str, times: int = 1, smooth: bool = False, sigma: float = 1.0) -> DataFrame:
    """(row, col, bin, rgba) of a grid (row, col, v), at times x times its cells and smoothed if asked."""
    fine = upsampled(grid, times) if times > 1 else grid
    fine = gaussian(fine, max(0.1, sigma)) if smooth else fine
    return fine.select("row", "col", index_bin(F.col("v"), index).alias("bin")).withColumn("rgba", painted(F.col("bin"), index))


def _score(weighted: Column, percent: Column) -> Column:
    return F.when(percent > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), weighted)), 2))


def _label_weight() -> Column:
    weight = F.lit(lookups.DEFAULT_WEIGHT)
    for label, w in lookups.LABEL_WEIGHTS.items():
        weight = F.when(F.lower(F.trim("label")) == label, w).otherwise(weight)
    return weight


def legend_score(legend: DataFrame) -> DataFrame:
    """(score, factor): the weighted share of the labels, null without any area."""
    used = legend.where("percent > 0").agg(F.sum(_label_weight() * F.col("percent") / 100).alias("w"), F.sum("percent").alias("p"))
    return used.select(_score(F.col("w"), F.col("p")).alias("score")).withColumn("factor", factor(F.col("score")))


def scores_of(counted: DataFrame, indices: dict[str, str]) -> DataFrame:
    """(name, score, factor) of several legends at once, given the cells (name, bin, n) of each; indices: the index by name. As merged_legend and legend_score do for one."""
    rows, spark = [], counted.sparkSession
    for name, index in indices.items():
        colors, labels = lookups.palette(index), lookups.labels(index)
        for i in range(max(len(colors), len(labels))):
            label = labels[i] if i < len(labels) else f"bin_{i}"
            rows.append((name, i, label if i < len(colors) else None, "No Data" if i == 0 else label))
    entries = spark.createDataFrame(rows, "name string, bin int, label string, shown string")  # some thirty rows
    percent = F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("name")) * 100, 2)
    areas = counted.withColumn("percent", percent).join(F.broadcast(entries.select("name", "bin", "shown")), ["name", "bin"], "left")
    areas = areas.select("name", F.coalesce("shown", F.concat(F.lit("bin_"), F.col("bin").cast("string"))).alias("label"), "percent")
    met = entries.where("label is not null").select("name", "label").join(areas, ["name", "label"], "left")
    shown = F.col("percent") > 0
    used = met.groupBy("name").agg(F.sum(F.when(shown, _label_weight() * F.col("percent") / 100)).alias("w"), F.sum(F.when(shown, F.col("percent"))).alias("p"))
    return used.select("name", _score(F.col("w"), F.col("p")).alias("score")).withColumn("factor", factor(F.col("score")))
