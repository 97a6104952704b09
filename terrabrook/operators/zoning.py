"""Zones, patches, doses and reports."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups
from ..functions.classify import absolute_zone, relative_zone
from ..functions.indices import index_column
from .grid import corner_lonlat
from .quality import clamp
from .quantiles import divided, exact_percentiles, grouped_percentiles, of_small, percentiles_of, sketched_percentiles
from .raster import components
from .scratch import saved


#: Bands that a soil analysis can't do without.
SOIL_BANDS = ("b02", "b04", "b08", "b11", "b12")


def soil_indices(pixels: DataFrame) -> DataFrame:
    """pixels with the six soil indices; null where a band of theirs is."""
    missing = [b for b in SOIL_BANDS if b not in pixels.columns]
    if missing:
        raise ValueError(f"soil indices need the bands {missing}")
    return pixels.withColumns({n.lower(): index_column(n, "soil") for n in ("NDVI", "NDWI", "SAVI", "BSI", "CLAY", "SWIR1")})


def soil_maps(indices: DataFrame) -> DataFrame:
    """Soil organic carbon (%) and N, P, K (kg/ha) from the soil indices."""
    out = indices.withColumn("soc", clamp(F.expr("0.8 + 1.5 * ndvi - 0.6 * bsi"), 0.1, 5.0))
    return out.withColumns({"n": clamp(F.expr("140 * soc"), 50.0, 600.0), "p": clamp(F.expr("15 + 40 * (savi + 0.2)"), 10.0, 80.0), "k": clamp(F.expr("80 + 120 * (clay - 0.7)"), 50.0, 350.0)})


def soc_stats(maps: DataFrame, res_m: float = 10.0) -> DataFrame:
    """One row: mean, least, most, deviation and area."""
    ha = F.count("soc") * (res_m * res_m) / lookups.M2_PER_HA
    return maps.agg(*(F.bround(f("soc"), 3).alias(n) for n, f in (("mean_pct", F.avg), ("min_pct", F.min), ("max_pct", F.max), ("std_pct", F.stddev_pop))), F.bround(ha, 3).alias("total_ha"), F.bround(ha * lookups.ACRES_PER_HA, 3).alias("total_acres"))


def soc_classes(maps: DataFrame, res_m: float = 10.0) -> DataFrame:
    """(class, pixels, ha, acres, pct_area) of all five classes, with or without pixels."""
    inside = lambda lo, hi: (F.lit(True) if lo is None else F.col("soc") >= lo) & (F.lit(True) if hi is None else F.col("soc") < hi)
    counts = maps.select("soc").agg(*(F.count_if(F.col("soc").isNotNull() & inside(lo, hi)).alias(f"n{i}") for i, (_, lo, hi) in enumerate(lookups.SOC_CLASSES)))
    total = sum((F.col(f"n{i}") for i in range(len(lookups.SOC_CLASSES))), F.lit(0))
    met = counts.select(total.alias("_all"), F.explode(F.array(*(F.struct(F.lit(label).alias("class"), F.col(f"n{i}").alias("pixels")) for i, (label, _, _) in enumerate(lookups.SOC_CLASSES)))).alias("c")).select("c.*", "_all")
    ha = F.col("pixels") * (res_m * res_m) / lookups.M2_PER_HA
    return met.select("class", "pixels", F.bround(ha, 3).alias("ha"), F.bround(F.bround(ha, 12) * lookups.ACRES_PER_HA, 3).alias("acres"), F.bround(F.col("pixels") / F.greatest("_all", F.lit(1)) * 100, 1).alias("pct_area"))


def mean_indices(indices: DataFrame, names: Sequence[str] = ("ndvi", "ndwi", "savi", "bsi", "swir1", "clay")) -> DataFrame:
    """One row: the mean of each index, to five places."""
    return indices.agg(*(F.bround(F.avg(n), 5).alias(n) for n in names))


def _zoned(values: DataFrame, v: str, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """values with `zone` by the inner edges of their group."""
    met = values.join(edges.withColumnRenamed("edges", "_edges"), list(keys), "left")
    return met.withColumn("zone", relative_zone(F.col(v), F.coalesce("_edges", F.array().cast("array<double>")))).drop("_edges")


def quantile_edges(values: DataFrame, v: str, n: int, keys: Sequence[str]) -> DataFrame:
    """(*keys, edges): the inner edges of n zones of each group; equal ones collapse, also with the least and the largest value."""
    _check(n)
    edges = F.array_sort(F.array_distinct("percentiles"))
    found = grouped_percentiles(values, keys, v, [k / n for k in range(n + 1)])
    return found.select(*keys, F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("edges"))


def quantile_zones(values: DataFrame, v: str, n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """values with `zone` from 1 to n by the quantiles of v, in each group that keys tell apart; ties share a zone."""
    if keys:
        return _zoned(values, v, quantile_edges(values, v, n, keys), keys)
    _check(n)
    edges = sorted(set(exact_percentiles(values, v, [k / n for k in range(n + 1)])))
    return values.withColumn("zone", relative_zone(F.col(v), F.array(*map(F.lit, edges[1:-1])).cast("array<double>")))


def kmeans_edges(values: DataFrame, v: str, k: int, rounds: int = 25) -> list[float]:
    """Inner edges between k centres of one dimension: seeds are the percentiles from 5 to 95. Equal values are counted once for all rounds; each round is one aggregate of k rows."""
    _check(k)
    seeds = exact_percentiles(values, v, [0.05 + 0.9 * i / (k - 1) for i in range(k)])
    if not seeds:
        return []
    data = saved(values.where(F.col(v).isNotNull()).groupBy(F.col(v).alias("_v")).agg(F.count("*").alias("_n")), "values")
    centres = list(seeds)
    for _ in range(rounds):
        near = F.array_min(F.array(*(F.struct(F.abs(F.col("_v") - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]
        means = {r["i"]: r["m"] for r in data.groupBy(near.alias("i")).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("m")).collect()}
        new = [means.get(i, c) for i, c in enumerate(centres)]
        same = all(abs(a - b) <= 1e-4 + 1e-5 * abs(a) for a, b in zip(centres, new, strict=True))
        centres = new
        if same:
            break
    centres.sort()
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def settled_edges(v: np.ndarray, seeds: Sequence[float], rounds: int) -> np.ndarray:
    """Inner edges between the centres that values settle on: a value goes to the nearest one, the first of equals; a centre without values stays."""
    c = percentiles_of(v, seeds)
    for _ in range(rounds):
        far = np.abs(v[:, None] - c)
        near = np.where(np.isnan(far), np.inf, far).argmin(1)
        n = np.bincount(near, minlength=len(c))
        new = np.where(n > 0, np.bincount(near, v, len(c)) / np.maximum(n, 1), c)
        same = (np.abs(c - new) <= 1e-4 + 1e-5 * np.abs(c)).all()
        c = new
        if same:
            break
    c = np.sort(c)
    return np.unique((c[:-1] + c[1:]) / 2)


def kmeans_edges_by(values: DataFrame, v: str, k: int, keys: Sequence[str], rounds: int = 25) -> DataFrame:
    """(*keys, edges): inner edges between k centres of one dimension, in each group; seeds are the percentiles from 5 to 95. Small groups settle each in a task, after one
    shuffle; large ones go by _large_kmeans()."""
    _check(k)
    seeds = [0.05 + 0.9 * i / (k - 1) for i in range(k)]
    small, large = divided(values, keys, v)
    out = of_small(small, keys, lambda x: settled_edges(x, seeds, rounds), "edges").drop("n")
    return saved(out if large is None else out.unionByName(_large_kmeans(large, keys, seeds, rounds)), "edges")


def _large_kmeans(series: DataFrame, keys: Sequence[str], seeds: Sequence[float], rounds: int) -> DataFrame:
    """kmeans_edges_by() of groups (*keys, _v) of any size. Equal values are counted once for all rounds; a round is one aggregate by group and centre over the groups whose centres still move."""
    names = list(keys)
    found = sketched_percentiles(series, keys, seeds)
    state = saved(found.select(*names, F.col("percentiles").alias("c"), F.lit(False).alias("still")), "centres")
    data = saved(series.groupBy(*names, "_v").agg(F.count("*").alias("_n")), "values")
    for _ in range(rounds):
        moving = state.where("not still")
        near = F.array_min(F.transform("c", lambda c, i: F.struct(F.abs(F.col("_v") - c).alias("d"), i.alias("i"))))["i"]
        means = data.join(moving, names).groupBy(*names, near.alias("i")).agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("m"))
        means = means.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))
        moved = moving.join(means, names).withColumn("new", F.transform("c", lambda c, i: F.coalesce(F.element_at("m", i), c)))
        same = F.forall(F.arrays_zip("c", "new"), lambda p: F.abs(p["c"] - p["new"]) <= 1e-4 + 1e-5 * F.abs(p["c"]))
        state = saved(moved.select(*names, F.col("new").alias("c"), same.alias("still")).unionByName(state.where("still")), "centres")
        if state.where("not still").isEmpty():
            break
    c = F.array_sort("c")
    between = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: (F.element_at(c, i) + F.element_at(c, i + 1)) / 2)
    return state.select(*names, F.array_distinct(between).alias("edges"))


def kmeans_zones(values: DataFrame, v: str, k: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """values with `zone` from 1 to k by k centres of v, in each group that keys tell apart."""
    if keys:
        return _zoned(values, v, kmeans_edges_by(values, v, k, keys), keys)
    edges = sorted(set(kmeans_edges(values, v, k)))
    return values.withColumn("zone", relative_zone(F.col(v), F.array(*map(F.lit, edges)).cast("array<double>")))


def _check(n: int) -> None:
    if not 2 <= n <= 7:
        raise ValueError("zones must be between 2 and 7")


def patches(cells: DataFrame, res_m: float = 10.0, named: DataFrame | None = None) -> DataFrame:
    """(grid, zone, patch_id, pixels, area_ha, patch_type, bounds): 4-connected cells of a zone; core from one hectare, else edge if they touch the grid's rim, else isolated. named: the
    4-connected components of the cells with a zone, where the caller has them."""
    rim = cells.groupBy("grid").agg(F.min("row").alias("_r1"), F.max("row").alias("_r2"), F.min("col").alias("_c1"), F.max("col").alias("_c2"))
    named = components(cells.where("z > 0"), False) if named is None else named
    found = named.groupBy("grid", F.col("z").alias("zone"), "label").agg(F.count("*").alias("pixels"), F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("col").alias("c1"), F.max("col").alias("c2"))
    area = F.bround(F.col("pixels") * (res_m * res_m) / lookups.M2_PER_HA, 4)
    touches = (F.col("r1") == F.col("_r1")) | (F.col("r2") == F.col("_r2")) | (F.col("c1") == F.col("_c1")) | (F.col("c2") == F.col("_c2"))
    kind = F.when(area >= 1.0, "core").when(touches, "edge").otherwise("isolated")
    # ranges of patches are numbered apart and offset by the sizes of those before
    found = saved(found.repartitionByRange("grid", "zone", "label").withColumn("_part", F.spark_partition_id()), "patches")
    sizes = found.groupBy("grid", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("grid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.join(sizes.select("grid", "_part", before.alias("_before")), ["grid", "_part"])
    order = (F.row_number().over(Window.partitionBy("grid", "_part").orderBy("zone", "label")) + F.col("_before")).cast("int")
    return found.join(rim, "grid").select("grid", "zone", order.alias("patch_id"), "pixels", area.alias("area_ha"), kind.alias("patch_type"), "r1", "r2", "c1", "c2", F.col("label.r0").alias("r0"), F.col("label.c0").alias("c0"))


def _rates(met: DataFrame, table: list[tuple], nutrient: str) -> DataFrame:
    """Doses of zones: met has zone, pixels, area_ha, patches."""
    spark = met.sparkSession
    doses = spark.createDataFrame([(i, label, *lookups.doses(nutrient, f)) for i, label, f in table], "zone int, label string, nutrient_dose double, product_dose double")
    all_ = F.broadcast(doses).join(met, "zone", "left")
    area = F.coalesce("area_ha", F.lit(0.0))
    return all_.select("zone", "label", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"), F.bround(area, 3).alias("area_ha"), F.bround(area * lookups.ACRES_PER_HA, 3).alias("area_acres"), "nutrient_dose", F.lit(lookups.PRODUCTS[nutrient][0]).alias("product"), "product_dose", F.bround(F.col("product_dose") * area, 1).alias("total_kg"), F.coalesce("patches", F.lit(0)).cast("long").alias("patches"))


def rates_from_patches(found: DataFrame, nutrient: str, n: int = 5) -> DataFrame:
    """Doses and totals of every zone; areas are sums of rounded patch areas."""
    met = found.groupBy("zone").agg(F.sum("pixels").alias("pixels"), F.sum("area_ha").alias("area_ha"), F.count("*").alias("patches"))
    return _rates(met, [(i + 1, label, f) for i, (label, f) in enumerate(zip(lookups.zone_labels(n), lookups.dose_fractions(n), strict=True))], nutrient)


def rates_by_grid(found: DataFrame, nutrient: str, n: int = 5) -> DataFrame:
    """rates_from_patches of each grid: every zone has a row in each, with or without patches."""
    met = found.groupBy("grid", "zone").agg(F.sum("pixels").alias("pixels"), F.sum("area_ha").alias("area_ha"), F.count("*").alias("patches"))
    table = [(i + 1, label, *lookups.doses(nutrient, f)) for i, (label, f) in enumerate(zip(lookups.zone_labels(n), lookups.dose_fractions(n), strict=True))]
    zones = F.explode(F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(row, ("zone", "label", "nutrient_dose", "product_dose"), strict=True))) for row in table)))
    rows = found.select("grid").distinct().select("grid", zones.alias("d")).select("grid", "d.*").join(met, ["grid", "zone"], "left")
    area = F.coalesce("area_ha", F.lit(0.0))
    return rows.select("grid", "zone", "label", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"), F.bround(area, 3).alias("area_ha"), F.bround(area * lookups.ACRES_PER_HA, 3).alias("area_acres"), "nutrient_dose", F.lit(lookups.PRODUCTS[nutrient][0]).alias("product"), "product_dose", F.bround(F.col("product_dose") * area, 1).alias("total_kg"), F.coalesce("patches", F.lit(0)).cast("long").alias("patches"))


def rates_absolute(maps: DataFrame, nutrient: str, res_m: float = 10.0) -> DataFrame:
    """The same by fixed thresholds and pixel counts."""
    zone = absolute_zone(F.col(nutrient.lower()), nutrient).alias("zone")
    met = maps.groupBy(zone).agg(F.count("*").alias("pixels")).withColumns({"area_ha": F.col("pixels") * (res_m * res_m) / lookups.M2_PER_HA, "patches": F.lit(0)})
    return _rates(met, [(i, label, lookups.ABSOLUTE_FRACTIONS[i]) for i, label in ((1, "Low"), (2, "Medium"), (3, "High"))], nutrient)


def placed(rings: Column, x0: float, y0: float, res_m: float, epsg: int) -> Column:
    """Rings of grid corners (row, col) as rings of (lon, lat), rounded to 7 places; (x0, y0) is the grid's upper left corner in the UTM zone. For many corners, outlines.traced() does it faster, corner by corner."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(*corner_lonlat(p[0], p[1], x0, y0, res_m, epsg))))


def features(found: DataFrame, rings: DataFrame | None = None, labels: Sequence[str] = (), at: tuple[float, float, float, int] | None = None) -> DataFrame:
    """(grid, patch_id, feature): GeoJSON features; the geometry is the traced rings, or else the bounding box. at: (x0, y0, res_m, epsg) of the grid for longitudes and latitudes, unless the rings were traced with it."""
    corners = F.array(*(F.array(F.col(r), F.col(c)) for r, c in (("r1", "c1"), ("r1", "c2x"), ("r2x", "c2x"), ("r2x", "c1"), ("r1", "c1"))))
    rows = found.withColumns({"c2x": (F.col("c2") + 1).cast("long"), "r2x": (F.col("r2") + 1).cast("long")}).withColumns({c: F.col(c).cast("long") for c in ("r1", "c1")})
    rows = rows.withColumn("rings", F.array(corners)) if rings is None else rows.join(rings.withColumnRenamed("z", "zone"), ["grid", "zone", "r0", "c0"])
    shape = placed(F.col("rings"), *at) if at else F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p[1].cast("double"), p[0].cast("double"))))
    name = F.element_at(F.array(*map(F.lit, labels)), F.col("zone")) if labels else F.concat(F.lit("Zone "), F.col("zone").cast("string"))
    properties = F.struct("patch_id", name.alias("zone_class"), "patch_type", "area_ha", F.col("pixels").alias("pixel_count"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), shape.alias("coordinates")).alias("geometry"), properties.alias("properties"))
    return rows.select("grid", "patch_id", F.to_json(feature).alias("feature"))


def collection_lines(features: DataFrame, epsg: int = 4326) -> DataFrame:
    """(grid, part, patch_id, line): the lines of each grid's FeatureCollection in order of part and patch_id, so that it can be written without being gathered. The features are made once, as a table."""
    features = saved(features, "features")
    first = features.groupBy("grid").agg(F.min("patch_id").alias("_first"))
    head = first.select("grid", F.lit(0).alias("part"), F.lit(0).alias("patch_id"), F.lit(f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"EPSG:{epsg}"}}}},"features":[').alias("line"))
    body = features.join(first, "grid").select("grid", F.lit(1).alias("part"), "patch_id", F.concat(F.when(F.col("patch_id") == F.col("_first"), "").otherwise(","), "feature").alias("line"))
    return head.unionByName(body).unionByName(first.select("grid", F.lit(2).alias("part"), F.lit(0).alias("patch_id"), F.lit("]}").alias("line")))


def report_rows(rates: DataFrame) -> DataFrame:
    """(zone, line): the lines of a report's dose table, zones without pixels left out."""
    line = F.concat(F.lit("    "), F.rpad("label", 12, " "), F.format_string(" %8d %10.3f %10.3f %12.1f %10.1f", "patches", "area_ha", "area_acres", "product_dose", "total_kg"))
    return rates.where("pixels > 0").select("zone", line.alias("line"))


#: The report's closing lines.
REPORT_END = (
    "  ── INTERPRETATION ────────────────────────────────────────────",
    "  Lowest zone class  = Soil is nutrient-deficient → highest dose",
    "  Highest zone class = Soil is nutrient-rich      → lowest dose",
    "  Zones are RELATIVE to this field (quantile/k-means breaks), and each",
    "  zone is a vectorized patch on the native Sentinel-2 grid.",
)


def text_report(meta: dict, stats: DataFrame, classes: DataFrame, rates: dict[str, DataFrame]) -> DataFrame:
    """(section, place, line): a field's report in order of section and place. meta: crop, date, cloud, collection, height, width, res_m, zones, method; stats and classes as of soc_stats and soc_classes; rates by nutrient. A few dozen rows."""
    spark, rule = stats.sparkSession, "═" * 70

    def fixed(section: int, lines: Sequence[str], start: int = 0) -> DataFrame:
        return spark.createDataFrame([(section, start + i, x) for i, x in enumerate(lines)], "section int, place int, line string")

    head = [rule, "  VARIABLE RATE APPLICATION (VRA) FIELD REPORT — Grid-Patch Edition", *(f"  {k:<12}: {v}" for k, v in (("Crop", meta["crop"]), ("Scene date", meta["date"]), ("Cloud cover", f"{meta['cloud']} %"), ("Data source", meta["collection"]), ("Grid", f"{meta['height']} × {meta['width']} px  @  {meta['res_m']:.1f} m/px (native Sentinel-2 resolution)"), ("Zones", f"{meta['zones']} ({meta['method']})"))), rule, "", "  ── SOIL ORGANIC CARBON (SOC) SUMMARY ─────────────────────────"]
    out = fixed(0, head)
    texts = [F.format_string(f"  {n:<6}: %.2f %%", c) for n, c in (("Mean", "mean_pct"), ("Min", "min_pct"), ("Max", "max_pct"))] + [F.format_string("  Field : %.2f ha  (%.2f acres)", "total_ha", "total_acres"), F.lit("")]
    out = out.unionByName(stats.select(F.lit(1).alias("section"), F.posexplode(F.array(*texts)).alias("place", "line")))
    names = F.create_map(*(F.lit(x) for i, (label, _, _) in enumerate(lookups.SOC_CLASSES) for x in (label, i)))
    out = out.unionByName(classes.select(F.lit(2).alias("section"), F.element_at(names, F.col("class")).alias("place"), F.concat(F.lit("  "), F.rpad("class", 28, " "), F.format_string(": %.3f ha  (%.3f ac)", "ha", "acres")).alias("line")))
    out = out.unionByName(fixed(3, ["", rule, "  ── VRA NUTRIENT ZONES & APPLICATION RATES (patch-based) ──", ""]))
    for k, (nutrient, table) in enumerate(rates.items()):
        product, percent = lookups.PRODUCTS[nutrient]
        titles = f"    {'Zone':<12} {'Patches':>8} {'Area (ha)':>10} {'Area (ac)':>10} {'Dose kg/ha':>12} {'Total kg':>10}"
        out = out.unionByName(fixed(4 + k, [f"  ► {nutrient} — {product}  ({percent:.0f}% nutrient)", titles, "    " + " ".join("─" * n for n in (12, 8, 10, 10, 12, 10))]))
        out = out.unionByName(report_rows(table).select(F.lit(4 + k).alias("section"), (F.col("zone") + 2).cast("int").alias("place"), "line")).unionByName(fixed(4 + k, [""], 100))
    return out.unionByName(fixed(4 + len(rates), [rule, *REPORT_END, rule]))
