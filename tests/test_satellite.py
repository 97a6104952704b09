import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabrook.functions import classify, lookups
from terrabrook.functions.indices import REGISTRY, canonical_name, index_column, is_radar, lookup, register_index, resolve_asset
from terrabrook.operators import grid, legend, mosaic, outlines, quality, quantiles, raster, scenes, zoning
from terrabrook.plans import analyses

PIXEL = {"b02": 0.05, "b03": 0.08, "b04": 0.10, "b05": 0.18, "b08": 0.40, "b8a": 0.42, "b11": 0.25, "b12": 0.15, "vv": 0.05, "vh": 0.01}
#: Worked out by hand from the formulas.
EXPECTED = {
    "calc": {"NDVI": 0.599999, "EVI": 0.461538, "EVI2": 0.457317, "SAVI": 0.45, "MSAVI": 0.441742, "NDMI": 0.230769, "SMI": 0.230769, "NDWI": -0.51515, "CCC": 4.049494, "NITROGEN": 0.285713, "SOC": 0.449999, "NDRE": 0.399999, "RECI": 1.222215, "RVI": 0.666656, "VH_VV": 0.199996, "VV_VH": 4.9995, "SDWI": -5.298117, "VV": -13.010213, "VH": -19.999566},
    "veg_ts": {"SUCROSE": 0.42857},
    "water_ts": {"NDMI": 0.230769, "NDWI": -0.666665, "SMI": 0.28, "MSI": 0.624998, "WI": 1.599994, "NMDI": 0.0},
    "soil": {"NDVI": 0.6, "NDWI": 0.454545, "SAVI": 0.45, "BSI": -0.125, "CLAY": 1.666667},
}


def one(df):
    return df.first()


def test_golden_indices(spark):
    row = spark.createDataFrame([PIXEL])
    for family, values in EXPECTED.items():
        got = one(row.select(*(index_column(n, family).alias(n) for n in values)))
        for name, want in values.items():
            assert got[name] == pytest.approx(want, abs=2e-6), (family, name)
    maps = one(zoning.soil_maps(zoning.soil_indices(row)))
    assert (maps["soc"], maps["n"], maps["p"], maps["k"]) == pytest.approx((1.775, 248.5, 41.0, 196.0))
    zero = row.withColumns({b: F.lit(0.0) for b in PIXEL})
    got = one(zero.select(*(index_column(n, f).alias(f"{f}_{n}") for f, n in REGISTRY)))
    assert got["calc_NDVI"] == 0 and got["soil_NDVI"] is None
    gone = row.withColumn("b08", F.lit(None).cast("double"))
    assert one(gone.select(index_column("msavi").alias("v")))["v"] is None


def test_registry():
    assert canonical_name("vv/vh") == "VV_VH" and canonical_name("sigma0") == "SIGMA0_VV"
    assert is_radar("VH_DB") and not is_radar("NDVI") and lookup("EVI").bands == ("b02", "b04", "b08")
    register_index("mine", "ratio", "b08 / nullif(b04, 0)")
    assert lookup("RATIO", "mine").bands == ("b04", "b08")
    del REGISTRY["mine", "RATIO"]
    with pytest.raises(ValueError):
        lookup("nothing")


def test_lookup_tables():
    assert lookups.dose_fractions(5) == [1.0, 0.812, 0.625, 0.438, 0.25] and lookups.dose_fractions(7)[1] == 0.875
    assert [lookups.doses("N", f) for f in lookups.dose_fractions(5)] == [(150.0, 326.1), (121.8, 264.8), (93.8, 203.9), (65.7, 142.8), (37.5, 81.5)]
    assert [lookups.doses("K", f)[1] for f in lookups.dose_fractions(5)] == [166.7, 135.3, 104.2, 73.0, 41.7]
    assert lookups.zone_colors(3)[0] == "#b71c1c" and lookups.zone_colors(3)[-1] == "#2e7d32"
    for name in lookups.PALETTES:
        assert len(lookups.palette(name)) == len(lookups.labels(name)) and len(lookups.edges(name)) == 12
    assert lookups.zone_labels(6)[5] == "Zone 6"


def test_bins_and_ladders(spark):
    values = [None, float("nan"), -5.0, -0.2, 0.0, 0.0999, 0.1, 1.0, 1.01, 9.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r[0] for r in df.select(legend.index_bin(F.col("v"), "NDVI")).collect()]
    assert bins == [0, 0, 1, 1, 2, 2, 3, 10, 10, 10, 10, 1]
    assert [r[0] for r in df.select(classify.vegetation_class("NDVI", F.col("v"))).collect()][:5] == ["No Data", "Very Good", "Very Poor", "Very Poor", "Very Poor"]
    days = spark.createDataFrame([(d,) for d in (20, 21, 60, 61, 100, 101, None)], "d int")
    assert [r[0] for r in days.select(classify.growth_stage(F.col("d"))).collect()] == ["germination", "vegetative", "vegetative", "flowering", "flowering", "maturity", "vegetative"]
    s = spark.createDataFrame([(0.5,), (0.1,), (0.95,), (-1.0,)], "v double")
    got = [r[0] for r in s.select(classify.stage_score(F.col("v"), F.lit(0.45), F.lit(0.8))).collect()]
    assert got == pytest.approx([85.0, 55 - 35.0, 97.5 - 0.15 / 0.35 * 20, 0.0])


def test_quality(spark):
    rows = [(1, 5000.0, 8), (1, 3000.0, 4), (2, 0.4, 9), (2, float("nan"), 4), (3, None, 4), (3, -1.0, None)]
    df = spark.createDataFrame(rows, "scene_id long, v double, scl int")
    got = {(r["scene_id"], r["scl"]): r["v"] for r in quality.scaled_reflectance(df, ["v"], ["scene_id"]).collect()}
    assert got[1, 8] == pytest.approx(0.5) and got[2, 9] == 0.4 and got[3, 4] is None
    power = {(r["scene_id"], r["scl"]): r["v"] for r in quality.radar_power(df, ["v"], ["scene_id"]).collect()}
    assert power[1, 4] == 9e6 and power[2, 9] == 0.4 and power[3, None] is None
    masked = {(r["scene_id"], r["scl"]): r["v"] for r in quality.mask_clouds(df, ["v"], (8, 9)).collect()}
    assert masked[1, 8] is None and masked[1, 4] == 3000.0 and masked[3, None] == -1.0


def test_scene_choice(spark):
    rows = [(1, "2024-01-01 10:00:00", 0.0, 0), (2, "2024-01-01 09:00:00", 30.0, 0), (3, "2024-01-02 10:00:00", None, 1), (4, "2024-01-02 11:00:00", None, 1), (5, "2024-01-09 10:00:00", 90.0, 1)]
    df = spark.createDataFrame(rows, "item_id long, acquired string, cloud double, provider int").withColumn("acquired", F.col("acquired").cast("timestamp_ntz"))
    assert {str(r["day"]): r["cloud_cover"] for r in scenes.availability(df).collect()} == {"2024-01-01": 30.0, "2024-01-02": None, "2024-01-09": 90.0}
    assert one(scenes.availability(df, False).orderBy("day"))["cloud_cover"] == 0.0
    assert sorted(r["item_id"] for r in scenes.best_per_date(df).collect()) == [2, 3, 5]
    assert sorted(r["item_id"] for r in scenes.provider_fallback(df, [7, 1, 0]).collect()) == [3, 4, 5]
    assert scenes.provider_fallback(df.limit(0), [0]).count() == 0
    assert [r["item_id"] for r in scenes.date_window(df, "2024-01-05", 3).collect()] == [3, 4]
    assert [r["item_id"] for r in scenes.cloud_ladder(df, "2024-01-01", "2024-01-01").collect()] == [1]
    assert sorted(r["item_id"] for r in scenes.cloud_ladder(df, "2024-01-04", "2024-01-05").collect()) == [1, 2, 5]
    assert [r["item_id"] for r in scenes.search(df, "2024-01-02", "2024-01-02").orderBy("item_id").collect()] == [3, 4]
    with pytest.raises(ValueError):
        scenes.search(df, "2024-02-01", "2024-01-01")
    nine = spark.range(9).withColumnRenamed("id", "day")
    assert sorted(r[0] for r in scenes.even_sample(nine, "day", 8).collect()) == sorted({round(i * 8 / 7) for i in range(8)})
    assert (scenes.points(None), scenes.points(3), scenes.points(99)) == (8, 8, 16)
    assets = spark.sql("select map('red', 's3://b/k/x.tif', 'B08', 'http://h') as assets")
    assert one(assets.select(scenes.http_url(resolve_asset("assets", "B04")), resolve_asset("assets", "B08"), resolve_asset("assets", "B11"), scenes.has_assets("assets", ["red", "B12"]))) == ("https://b.s3.amazonaws.com/k/x.tif", "http://h", None, False)


def test_mosaic_and_fill(spark):
    rows = [(0, 1, 1, 0.1, 0.2), (0, 1, 2, 0.3, 0.4), (1, 2, 1, None, 0.2), (1, 2, 2, 0.5, 0.6), (2, 3, 3, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, rank int, x double, y double")
    first = {r["a"]: r["x"] for r in mosaic.first_valid(df, ["a", "b"], ["x", "y"], ["rank"]).collect()}
    assert first == {0: 0.1, 1: 0.5}
    median = {r["a"]: r["x"] for r in mosaic.temporal_median(df, ["a", "b"], ["x", "y"], ["rank"]).collect()}
    assert median == {0: pytest.approx(0.2), 1: 0.5, 2: None}
    base = spark.createDataFrame([(0, 1, None, None), (1, 2, 0.9, 0.9), (2, 3, None, None)], "a int, b int, x double, y double")
    fill = mosaic.temporal_median(df, ["a", "b"], ["x", "y"], ["rank"])
    assert {r["a"]: r["x"] for r in mosaic.fill_if_sparse(base, fill, ["a", "b"], ["x", "y"]).collect()} == {0: pytest.approx(0.2), 1: 0.9, 2: None}
    assert {r["a"]: r["x"] for r in mosaic.fill_if_sparse(base, fill, ["a", "b"], ["x", "y"], 0.3).collect()} == {0: None, 1: 0.9, 2: None}


def grid_of(spark, a, name="v", kind="double"):
    rows = [(r, c, None if isinstance(a[r, c], float) and math.isnan(a[r, c]) else a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"row long, col int, {name} {kind}")


def array_of(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_gaussian_median_resample(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(11, 9))
    a[2, 3] = a[7:9, 0:2] = np.nan
    kernel = np.exp(-np.arange(-4, 5) ** 2 / 2)
    kernel /= kernel.sum()
    flip = lambda i, n: -1 - i if i < 0 else 2 * n - 1 - i if i >= n else i

    def smooth(m):
        for axis in (1, 0):
            out = np.zeros_like(m)
            for i in range(m.shape[0]):
                for j in range(m.shape[1]):
                    for k, x in zip(range(-4, 5), kernel):
                        out[i, j] += x * (m[i, flip(j + k, m.shape[1])] if axis else m[flip(i + k, m.shape[0]), j])
            m = out
        return m

    want = smooth(np.nan_to_num(a)) / smooth(np.isfinite(a).astype(float))
    g = grid_of(spark, a)
    assert np.allclose(array_of(raster.gaussian(g), a.shape), want)
    assert np.allclose(array_of(raster.gaussian(grid_of(spark, np.full((6, 5), 3.25))), (6, 5)), 3.25)
    z = rng.integers(0, 4, (7, 8)).astype(float)
    want = np.array([[np.median([z[min(max(i + p, 0), 6), min(max(j + q, 0), 7)] for p in (-1, 0, 1) for q in (-1, 0, 1)]) for j in range(8)] for i in range(7)])
    assert np.array_equal(array_of(raster.median3x3(grid_of(spark, z)), z.shape), want)
    assert np.array_equal(array_of(raster.nearest(grid_of(spark, z), 7, 8), z.shape), z)
    assert np.allclose(array_of(raster.bilinear(grid_of(spark, z), 7, 8), z.shape), z)
    assert array_of(raster.median3x3(grid_of(spark, np.array([[2.0]]))), (1, 1))[0, 0] == 2.0


def label(z, diagonal):
    seen, out = {}, {}
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if (r, c) in seen:
                continue
            stack = [(r, c)]
            seen[r, c] = (r, c)
            while stack:
                i, j = stack.pop()
                out[i, j] = (r, c)
                for p, q in near:
                    x = (i + p, j + q)
                    if 0 <= x[0] < z.shape[0] and 0 <= x[1] < z.shape[1] and x not in seen and z[x] == z[i, j]:
                        seen[x] = (r, c)
                        stack.append(x)
    return out


def cells_of(spark, z):
    return grid_of(spark, z, "z", "int").select(F.lit(0).cast("long").alias("grid"), "row", "col", "z")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_dissolve_and_rings(spark, seed):
    rng = np.random.default_rng(seed)
    z = rng.integers(1, 4, (14, 12))
    for diagonal in (False, True):
        got = {(r["row"], r["col"]): (r["label"]["r0"], r["label"]["c0"]) for r in raster.components(cells_of(spark, z).repartition(5), diagonal).collect()}
        assert got == label(z, diagonal)
    want, marks = z.copy(), label(z, True)
    patches = defaultdict(list)
    for cell, mark in marks.items():
        patches[mark].append(cell)
    for mark, cells in patches.items():
        if len(cells) < 5:
            rs, cs = [c[0] for c in cells], [c[1] for c in cells]
            votes = Counter(int(z[i, j]) for i in range(max(0, min(rs) - 1), min(14, max(rs) + 2)) for j in range(max(0, min(cs) - 1), min(12, max(cs) + 2)) if z[i, j] != z[mark])
            if votes:
                best = min(votes, key=lambda k: (-votes[k], k))
                for cell in cells:
                    want[cell] = best
    assert np.array_equal(array_of(raster.dissolved(cells_of(spark, z), 5), z.shape, "z"), want)
    areas = Counter(label(z, False).values())
    for r in outlines.traced(cells_of(spark, z)).collect():
        twice = sum(a[1] * b[0] - b[1] * a[0] for ring in r["rings"] for a, b in zip(ring, ring[1:]))
        assert abs(twice) == 2 * areas[r["r0"], r["c0"]] and all(ring[0] == ring[-1] for ring in r["rings"])


def test_zones(spark):
    values = [float(x) for x in np.random.default_rng(4).normal(size=400)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    edges = np.percentile([v for v in values if v is not None], [20, 40, 60, 80])
    got = {r["i"]: r["zone"] for r in zoning.quantile_zones(df, "v").collect()}
    assert got == {i: 0 if v is None else 1 + int((edges < v).sum()) for i, v in enumerate(values)}
    flat = df.withColumn("v", F.lit(2.0))
    assert {r["zone"] for r in zoning.quantile_zones(flat, "v").collect()} == {1}
    data = np.array([v for v in values if v is not None])
    centres = np.percentile(data, np.linspace(5, 95, 4))
    for _ in range(25):
        near = np.abs(data[:, None] - centres).argmin(1)
        new = np.array([data[near == k].mean() if (near == k).any() else centres[k] for k in range(4)])
        done = np.allclose(centres, new, atol=1e-4)
        centres = new
        if done:
            break
    centres.sort()
    assert zoning.kmeans_edges(df, "v", 4) == pytest.approx(list((centres[1:] + centres[:-1]) / 2), abs=1e-6)
    with pytest.raises(ValueError):
        zoning.quantile_zones(df, "v", 8)


def test_patches_and_rates(spark):
    z = np.ones((30, 12), int)
    z[10:12, 4:6] = 2
    z[0, 0] = 3
    found = zoning.patches(cells_of(spark, z))
    got = {r["zone"]: (r["pixels"], r["area_ha"], r["patch_type"]) for r in found.collect()}
    assert got == {1: (355, 3.55, "core"), 2: (4, 0.04, "isolated"), 3: (1, 0.01, "edge")}
    rates = {r["zone"]: r for r in zoning.rates_from_patches(found, "N", 5).collect()}
    assert rates[1]["total_kg"] == round(326.1 * 3.55, 1) and rates[5]["pixels"] == 0 and rates[2]["patches"] == 1
    assert len([r for r in zoning.report_rows(zoning.rates_from_patches(found, "N", 5)).collect()]) == 3
    features = zoning.features(found, outlines.traced(cells_of(spark, z)), lookups.zone_labels(5)).collect()
    assert len(features) == 3 and all('"type":"Feature"' in r["feature"] for r in features)


def test_projection_and_polygon(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(72, 78), rng.uniform(-79, 83)) for _ in range(200)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for epsg in (32643, 32743):
        x, y = grid.to_utm(F.col("lon"), F.col("lat"), epsg)
        lon, lat = grid.from_utm(F.col("x"), F.col("y"), epsg)
        for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
    middle = one(spark.range(1).select(*grid.to_utm(F.lit(75.0), F.lit(0.0), 32643)))
    assert tuple(middle) == pytest.approx((500000.0, 0.0), abs=1e-6)
    # the meridian's length to 45 degrees is 4,984,944.378 m
    assert one(spark.range(1).select(grid.to_utm(F.lit(75.0), F.lit(45.0), 32643)[1]))[0] == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    square = [[(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0)], [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]]
    cells = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    assert {(r["row"], r["col"]) for r in grid.rasterised(cells, square).collect()} == {(r, c) for r in (1, 2, 3) for c in (1, 2, 3, 4)} - {(2, 2)}
    with pytest.raises(ValueError):
        grid.to_utm(F.lit(0.0), F.lit(0.0), 4326)


def test_legend_and_scores(spark):
    df = spark.createDataFrame([(0.15,)] * 3 + [(0.85,)] + [(None,)], "v double")
    rows = {r["label"]: (r["hectares"], r["percent"]) for r in legend.merged_legend(df, "v", "NDVI").collect()}
    assert rows["Fair"] == (0.03, 60.0) and rows["Clouds"] == (0.0, 0.0) and len(rows) == 11
    scored = one(legend.legend_score(legend.merged_legend(df, "v", "NDVI")))
    assert scored["score"] == pytest.approx(0.6 * 42 + 0.2 * 98) and scored["factor"] == 0.55
    assert one(legend.legend_score(legend.merged_legend(df.limit(0), "v", "NDVI"))) == (None, 0.7)
    assert one(spark.range(1).select(legend.darkened(legend.rgba(F.lit("#d73027")))))[0] == [176, 39, 31, 255]
    health = one(analyses.crop_health(spark.createDataFrame([{**PIXEL, "scene_id": 1, "scl": 4}]), 45))
    assert health["health"] == round(0.6 * 90 + 0.4 * 80) and health["stage"] == "vegetative" and health["status"] == "Healthy"


def test_components_cross_tiles(spark, monkeypatch):
    """A spiral in one class, and random cells with holes, over many small tiles: no task has more than a tile."""
    monkeypatch.setattr(raster, "TILE", 4)
    n = 9
    spiral = {(0, c) for c in range(n)} | {(r, n - 1) for r in range(n)} | {(n - 1, c) for c in range(n)} | {(r, 0) for r in range(2, n)} | {(2, c) for c in range(n - 2)} | {(r, n - 3) for r in range(2, n - 2)}
    cells = spark.createDataFrame([(5, r, c, 1 if (r, c) in spiral else 2) for r in range(n) for c in range(n)], "grid long, row long, col int, z int")
    named = raster.components(cells, False)
    assert {tuple(r["label"]) for r in named.where("z = 1").collect()} == {(0, 0)}
    assert named.count() == n * n
    rng = np.random.default_rng(6)
    z = rng.integers(1, 3, (19, 14))
    for diagonal in (False, True):
        got = {(r["row"], r["col"]): tuple(r["label"]) for r in raster.components(cells_of(spark, z), diagonal).collect()}
        assert got == label(z, diagonal)
    two = cells_of(spark, z).unionByName(cells_of(spark, z).withColumn("grid", F.lit(1).cast("long"))).where("(row + col) % 5 > 0")
    sizes = [sorted(r["n"] for r in raster.components(two.where(f"grid = {g}"), True).groupBy("label").agg(F.count("*").alias("n")).collect()) for g in (0, 1)]
    both = raster.components(two, True).groupBy("grid", "label").agg(F.count("*").alias("n")).collect()
    assert sizes[0] == sizes[1] == sorted(r["n"] for r in both if r["grid"] == 1)
    assert raster.components(cells.limit(0), True).count() == 0


def test_dissolve_leaves_out_the_own_zone(spark):
    """A diagonal of four cells, whose box is mostly other patches of its zone, takes the smaller of two other zones that are as frequent."""
    z = np.full((6, 6), 0)
    for i in range(1, 5):
        z[i, i] = 1
    free = [(r, c) for r in range(6) for c in range(6) if z[r, c] == 0]
    apart = [(r, c) for r, c in free if all(max(abs(r - i), abs(c - i)) > 1 for i in range(1, 5))]
    for k, cell in enumerate(c for c in free if c not in apart):
        z[cell] = 2 + k % 2
    for cell in apart:
        z[cell] = 1
    want = {2: 0, 3: 0}
    for cell in free:
        if z[cell] in want:
            want[z[cell]] += 1
    got = array_of(raster.dissolved(cells_of(spark, z), 5), z.shape, "z")
    assert {got[i, i] for i in range(1, 5)} == {min(want, key=lambda k: (-want[k], k))}


def test_percentiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = np.concatenate((rng.normal(size=4000), np.full(3000, 0.25), rng.integers(0, 5, 900)))
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,), (float("nan"),)], "v double").repartition(5)
    fractions = [0.0, 0.02, 0.2, 0.5, 0.77, 0.98, 1.0]
    monkeypatch.setattr(quantiles, "GATHERED", 40)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    assert quantiles.exact_percentiles(df, "v", fractions) == pytest.approx(list(np.quantile(data, fractions)), abs=1e-12)
    assert quantiles.exact_percentiles(df.limit(0), "v", fractions) == []
    assert quantiles.exact_percentiles(spark.createDataFrame([(3.0,)], "v double"), "v", fractions) == [3.0] * 7


def test_search_helpers(spark):
    box = lambda x, y: [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0)]
    rows = [(1, box(0.0, 0.0)), (2, box(2.5, 2.5)), (3, box(9.0, 9.0)), (4, box(5.0, 0.0)), (5, [(-9.0, -9.0), (30.0, -9.0), (30.0, 30.0), (-9.0, 30.0)]), (6, [])]
    df = spark.createDataFrame(rows, "item_id long, footprint array<struct<x:double,y:double>>")
    field = [[(1.0, 1.0), (6.0, 1.0), (6.0, 6.0), (1.0, 6.0)]]
    assert sorted(r["item_id"] for r in scenes.intersecting(df, field).collect()) == [1, 2, 4, 5]
    apart = [[(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)]]
    assert [r["item_id"] for r in scenes.intersecting(df, apart).collect()] == [5]
    assert lookups.collections("S1-GRD") == ("sentinel-1-rtc",) and lookups.collections(None)[0] == "sentinel-2-l2a"
    assert lookups.provider_order("PC") == ("planetary",) and lookups.provider_order(None) == ("planetary", "aws") and lookups.provider_order("both", "aws") == ("aws", "planetary")
    assert (lookups.crop_key("Onion"), lookups.crop_key(None), lookups.crop_key("quinoa")) == ("onion", "wheat", "default")
    assets = spark.sql("select map('zzz', 's3://b/z', 'aaa', '') as a, array('ftp://x', 'https://y') as o union all select map(), array() union all select map('B04', 'http://h', 'vv', 's3://b/v'), null")
    got = [tuple(r) for r in assets.select(scenes.first_asset("a"), scenes.prefer_http(F.lit("gs://q"), F.col("o"))).collect()]
    assert got == [("https://b.s3.amazonaws.com/z", "https://y"), (None, "gs://q"), ("https://b.s3.amazonaws.com/v", "gs://q")]


def test_geojson_in_and_out(spark):
    text = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[75,20],[76,20],[75,21]],[[75.2,20.2],[75.3,20.2],[75.2,20.3]]]}',), ('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[1,2],[3,4],[5,6]]]]}}',), ("no json",), (None,)], "t string")
    rings = [r[0] for r in text.select(grid.rings_of(F.col("t"))).collect()]
    assert [len(r) if r else r for r in rings[:2]] == [2, 1] and rings[0][1][0]["x"] == 75.2 and not rings[2] and not rings[3]
    moved = one(text.limit(1).select(grid.reprojected(grid.rings_of(F.col("t")), 32643)))[0]
    assert moved[0][0]["x"] == pytest.approx(500000, abs=1e-6) and moved[0][0]["y"] == pytest.approx(0.9996 * 2212366.254, abs=0.01)
    z = np.ones((8, 6), int)
    z[2:4, 2:4] = 2
    cells = cells_of(spark, z)
    made = zoning.features(zoning.patches(cells), outlines.traced(cells), lookups.zone_labels(2), (500000.0, 2200000.0, 10.0, 32643))
    lines = "".join(r["line"] for r in zoning.collection_lines(made).orderBy("grid", "part", "patch_id").collect())
    whole = json.loads(lines)
    assert whole["type"] == "FeatureCollection" and [f["properties"]["zone_class"] for f in whole["features"]] == ["Low", "High"]
    assert len(whole["features"][0]["geometry"]["coordinates"]) == 2 and whole["features"][0]["geometry"]["coordinates"][0][0][0] == pytest.approx(75.0, abs=1e-6)


def test_report_is_in_order(spark):
    maps = spark.createDataFrame([(0.2,), (1.0,), (2.5,)], "soc double")
    rates = zoning.rates_from_patches(zoning.patches(cells_of(spark, np.array([[1, 1], [2, 2]]))), "N", 5)
    meta = {"crop": "onion", "date": "2024-01-10", "cloud": 3.5, "collection": "c", "height": 2, "width": 2, "res_m": 10.0, "zones": 5, "method": "quantile"}
    lines = [r["line"] for r in zoning.text_report(meta, zoning.soc_stats(maps), zoning.soc_classes(maps), {"N": rates}).orderBy("section", "place").collect()]
    assert lines[2] == "  Crop        : onion" and "  Mean  : 1.23 %" in lines and lines[-1] == "═" * 70
    assert "    Very Low            1      0.020      0.049        326.1        6.5" in lines and sum(x.startswith("    ") for x in lines) == 4
    assert "  Very Low  (<0.3%)           : 0.010 ha  (0.025 ac)" in lines


def test_reading_and_fields(spark):
    rows = [(1, r, c, 4, 5000.0 if c else None, 3000.0, 0.5) for r in range(4) for c in range(4)] + [(2, 0, 0, 9, None, None, -3.0)] + [(3, 1, 1, None, float("inf"), 0.1, 3.0)]
    df = spark.createDataFrame(rows, "scene_id long, row int, col int, scl int, b08 double, b04 double, vv double")
    read = quality.stacked(df, ["b08", "b04"], ["scene_id"])
    assert {r["scene_id"] for r in read.collect()} == {1, 3} and one(read.where("scene_id = 1 and col = 1"))["b08"] == pytest.approx(0.5)
    assert one(read.where("scene_id = 3"))["b08"] is None
    assert {r["scene_id"]: r["vv"] for r in quality.stacked(df, ["vv"], ["scene_id"]).collect()} == {1: 0.5, 3: 9.0}
    half = analyses.Field([[(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)]], spark.createDataFrame([(4, 4)], "h long, w long"))
    assert half.clip(df.where("scene_id = 1")).count() == 8
    assert one(analyses.pick_scene(df, half)) == (1, 50.0)
    clouded = analyses.crop_health(df.withColumns({"b05": F.lit(0.1), "b8a": F.lit(0.4), "scl": F.lit(9)}), 45).collect()
    assert {r["health"] for r in clouded} == {None} and {r["cloud_coverage"] for r in clouded} == {100.0}
    grid_ = df.where("scene_id = 1").select("row", "col", (F.col("row") * 10 + F.col("col")).cast("double").alias("v"))
    assert {(r["row"], r["col"]): r["v"] for r in raster.window(grid_, 1, 2, 4, 2, 2, 1).collect()} == {(0, 0): 23.0, (1, 0): None}
    assert one(legend.rendered(grid_.limit(1).withColumn("v", F.lit(None).cast("double")), "NDVI"))["rgba"] == [0, 0, 0, 0]
    with pytest.raises(ValueError):
        zoning.soil_indices(df)


def test_tiles_with_rims(spark, monkeypatch):
    """Small tiles give what one large tile gives, for several grids at once, with holes; the shuffle is little more than the cells."""
    from terrabrook.operators import tiles

    rng = np.random.default_rng(3)
    shapes = {1: (37, 21), 2: (3, 50), 3: (1, 1), 4: (20, 20)}
    rows = [(g, r, c, None if rng.random() < 0.2 else float(rng.normal())) for g, (h, w) in shapes.items() for r in range(h) for c in range(w) if g != 4 or (r + c) % 3]
    cells = spark.createDataFrame(rows, "g int, row long, col int, v double")

    def direct(run, radius):
        out = {}
        for g, (h, w) in shapes.items():
            a = np.full((h, w), np.nan)
            for k, r, c, v in rows:
                if k == g and v is not None:
                    a[r, c] = v
            ri, ci = tiles._source(-radius, h + 2 * radius, h), tiles._source(-radius, w + 2 * radius, w)
            out[g] = run([a[ri][:, ci]], radius)[0]
        return {(g, r, c): out[g][r, c] for g, r, c, _ in rows}

    for op, run, radius in ((lambda s: raster.gaussian(cells, 1.3, keys=["g"]), None, 5), (lambda s: raster.median3x3(cells, ["g"]), tiles.medians, 1)):
        if run is None:
            kernel = [np.exp(-(k * k) / (2 * 1.3 * 1.3)) for k in range(-radius, radius + 1)]
            run = tiles.smoothed([x / sum(kernel) for x in kernel])
        want = direct(run, radius)
        for side in (256, 12):
            monkeypatch.setattr(tiles, "SIDE", side)
            got = {(r["g"], r["row"], r["col"]): r["v"] for r in op(side).collect()}
            assert got.keys() == want.keys()
            assert all((v is None and np.isnan(want[k])) or abs(v - want[k]) < 1e-12 for k, v in got.items())
    large = spark.range(400 * 300).select(F.lit(1).alias("g"), F.floor(F.col("id") / 300).alias("row"), (F.col("id") % 300).cast("int").alias("col"), F.rand(1).alias("v"))
    assert tiles.haloed(large, ["v"], 4, ["g"], None, 256).count() <= 1.3 * large.count()
    assert raster.gaussian(cells.limit(0), 1.0, keys=["g"]).count() == 0


def test_grouped_percentiles_and_zones(spark, monkeypatch):
    from terrabrook.operators import quantiles, zoning

    monkeypatch.setattr(quantiles, "SMALL", 40)
    rng = np.random.default_rng(4)
    groups = {1: rng.normal(size=5000), 2: np.full(300, 2.5), 3: np.array([1.0]), 4: rng.integers(0, 4, 900).astype(float), 5: np.exp(8 * rng.normal(size=2000)), 6: np.array([np.nan])}
    df = spark.createDataFrame([(g, float(x), i) for g, xs in groups.items() for i, x in enumerate(xs)] + [(7, None, 0), (1, None, -1)], "g int, v double, i int").repartition(6)
    fractions = [0.0, 0.02, 0.31, 0.5, 0.98, 1.0]
    got = {r["g"]: r for r in quantiles.grouped_percentiles(df, ["g"], "v", fractions).collect()}
    assert got.keys() == {1, 2, 3, 4, 5}
    for g, r in got.items():
        assert r["n"] == len(groups[g]) and np.allclose(r["percentiles"], np.quantile(groups[g], fractions), rtol=1e-12, atol=0)
    zones = zoning.quantile_zones(df, "v", 4, ["g"]).collect()
    for r in zones:
        x = np.array(groups.get(r["g"], []))
        if r["v"] is not None and not np.isnan(r["v"]):
            inner = np.unique(np.quantile(x, np.arange(5) / 4))[1:-1]
            assert r["zone"] == 1 + (inner < r["v"]).sum()
    alone = {g: sorted((r["i"], r["zone"]) for r in zoning.kmeans_zones(df.where(f"g = {g}"), "v", 3).collect()) for g in (1, 4)}
    both = zoning.kmeans_zones(df, "v", 3, ["g"]).collect()
    assert all(sorted((r["i"], r["zone"]) for r in both if r["g"] == g) == z for g, z in alone.items())


def test_outlines_in_degrees_are_worked_out_a_row_a_corner(spark, monkeypatch):
    """Patches and outlines share one labelling, a feature is made once, and no projection is left in a lambda over a ring, where none of its terms is shared."""
    from terrabrook.operators import scratch

    z = np.random.default_rng(11).integers(0, 3, (9, 7))
    cells, at = cells_of(spark, z), (500000.0, 2200000.0, 10.0, 32643)
    names = []
    monkeypatch.setattr(raster, "saved", lambda df, name: names.append(name) or scratch.saved(df, name))
    named = scratch.saved(raster.components(cells.where("z > 0"), False), "named")
    outline = outlines.traced(cells, named=named, at=at)
    made = zoning.features(zoning.patches(cells, named=named), outline, lookups.zone_labels(2))
    assert names == ["tiles"]
    plan = made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "atanh" in plan and not any("lambdafunction" in part and "atanh" in part for part in plan.split("\n"))
    lines = zoning.collection_lines(made)
    assert "atanh" not in lines._jdf.queryExecution().optimizedPlan().toString().lower()
    before = zoning.collection_lines(zoning.features(zoning.patches(cells), outlines.traced(cells), lookups.zone_labels(2), at))
    text = lambda df: [r["line"] for r in df.orderBy("grid", "part", "patch_id").collect()]
    assert text(lines) == text(before) and json.loads("".join(text(lines)))["features"]


def test_narrow_grids_have_tall_tiles(spark, monkeypatch):
    """A grid of 3 columns isn't cut into as many tiles as rows / SIDE, and smoothing is the same whatever the tiles."""
    from terrabrook.operators import tiles

    cells = spark.range(900).select(F.floor(F.col("id") / 3).alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.when(F.col("id") % 7 != 0, F.rand(1)).alias("v"))
    seen = []
    haloed = tiles.haloed
    monkeypatch.setattr(tiles, "haloed", lambda *a: seen.append(haloed(*a)) or seen[-1])
    whole = array_of(raster.gaussian(cells, 1.0), (300, 3))
    monkeypatch.setattr(tiles, "SIDE", 12)
    assert np.allclose(array_of(raster.gaussian(cells, 1.0), (300, 3)), whole, rtol=1e-12, atol=0)
    at = seen[-1].select("_r").distinct().count()
    assert at == -(-300 // tiles.height_of(3, 12, 4)) and 1 < at < 300 / 12
    assert (tiles.height_of(3, 12, 4) + 8) * (3 + 8) <= (12 + 8) ** 2 and tiles.height_of(12, 12, 4) == tiles.height_of(90, 12, 4) == 12


def test_fields_are_cut_out_before_scenes_meet(spark):
    """Cells outside of the field aren't shuffled to their scene's largest values, which are those of all its cells; and the JVM compiles every method of the plan, none being above 8000 bytes."""
    import re

    from terrabrook.plans import catalog

    rows = [(1, i, 0, 5, *(x,) * 5) for i, x in enumerate((0.2, 0.4, 9000.0, 0.1))]
    df = spark.createDataFrame(rows, "scene_id int, row int, col int, scl int, b02 double, b04 double, b08 double, b11 double, b12 double")
    field = analyses.Field([[(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)]], spark.createDataFrame([(4, 1)], "h long, w long"))
    got = {r["row"]: r["b02"] for r in analyses.read(df, zoning.SOIL_BANDS, field).collect()}
    assert got == {0: pytest.approx(0.2e-4), 1: pytest.approx(0.4e-4)}
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        plan = catalog.queries()["soil_field_means"](spark, "/root/testdata/sf0.001")
        text = spark._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "codegen")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000


def test_ranks_in_one_bracket_share_a_sketch(spark, monkeypatch):
    """Four percentiles ask for eight ranks, and the first round for one sketch of all values, not eight."""
    made = []
    sketch = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: made.append(a) or sketch(*a))
    monkeypatch.setattr(quantiles, "GATHERED", 50)
    data = np.random.default_rng(12).normal(size=4000)
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    fractions = [0.21, 0.43, 0.61, 0.87]
    assert quantiles.exact_percentiles(df, "v", fractions) == pytest.approx(list(np.quantile(data, fractions)), abs=1e-12)
    alike = [str(a[0]) for a in made]
    assert made and len(alike) == len(set(alike))


def test_small_groups_settle_in_one_shuffle(spark, monkeypatch):
    """Groups that fit a task don't take a saved table and a shuffle of all values a round; both ways give the same zones, with equal centres and missing values too."""
    from terrabrook.operators import scratch

    rng = np.random.default_rng(9)
    groups = {f"g{i}": rng.normal(size=3 + 17 * i) for i in range(6)} | {"same": np.full(50, 1.5), "two": np.array([0.0, 0.0, 4.0]), "none": np.array([np.nan, np.nan])}
    rows = [(g, i, float(x)) for g, xs in groups.items() for i, x in enumerate(xs)] + [("g1", -1, None), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(4)
    names = []
    monkeypatch.setattr(zoning, "saved", lambda df, name: names.append(name) or scratch.saved(df, name))
    zones = lambda: sorted(((r["g"] or "", r["i"], r["zone"]) for k in (2, 5) for r in zoning.kmeans_zones(df, "v", k, ["g"]).collect()))
    small = zones()
    assert names == ["edges", "edges"] and len(small) == 2 * len(rows)
    monkeypatch.setattr(quantiles, "SMALL", 0)
    assert zones() == small and "centres" in names


def test_requests_are_judged(spark):
    from terrabrook.plans import requests as service

    rows = [(1, "2024-01-05", "ndvi", "s2", "both"), (2, "5 January", "ndvi", "s2", None), (3, "2024-13-01", "ndvi", None, "pc"), (4, "2024-01-05", "vh/vv", "S1", "AWS"), (5, "2024-01-05", "vh/vv", "s2", ""), (6, "2024-01-05", "NDVI", "s1-rtc", None), (7, "2024-01-05", "soil", "s2", None), (8, "2024-1-5", "evi", None, "aws"), (9, None, None, None, None)]
    got = {r["request_id"]: r for r in service.judged(spark.createDataFrame(rows, "request_id int, day string, index_name string, satellite string, provider string")).collect()}
    assert {i for i, r in got.items() if r["status"] == 400} == {2, 3, 5, 6, 7, 9}
    assert got[2]["detail"] == got[3]["detail"] == "date must be YYYY-MM-DD" and "requires" in got[5]["detail"] and "not available" in got[6]["detail"] and got[7]["detail"] == "Unsupported index: SOIL"
    assert (got[4]["index_name"], got[4]["radar"], got[4]["_prefer"], got[4]["_named"]) == ("VH_VV", True, "planetary", ["aws"])
    assert (got[8]["_prefer"], got[8]["_named"], str(got[8]["day"])) == ("aws", ["aws"], "2024-01-05") and got[1]["_named"] == ["planetary", "aws"]


def test_requests_fill_from_other_dates(spark):
    """Of four cells the picked scene shows one: the others take medians of other scenes within the days, never its own."""
    from terrabrook.plans import requests as service

    asked = spark.createDataFrame([(1, "2024-02-01", "NDVI", "s2", "both"), (2, "2024-06-01", "NDVI", "s2", "both"), (3, "2024-02-01", "NDVI", "s2", "aws")], "request_id int, day string, index_name string, satellite string, provider string")
    scenes_ = [(10, "2024-02-01", "planetary"), (11, "2024-02-09", "planetary"), (12, "2024-01-25", "planetary"), (13, "2024-02-20", "planetary"), (14, "2024-02-02", "aws")]
    scenes_ = spark.createDataFrame([(i, d, p, "sentinel-2-l2a") for i, d, p in scenes_], "item_id int, acquired string, provider string, collection string").withColumn("acquired", F.col("acquired").cast("timestamp_ntz"))
    value = {10: {0: 0.6}, 11: {0: 0.1, 1: 0.2, 2: 0.3}, 12: {1: 0.4}, 13: {3: 0.9}, 14: {3: 0.5}}
    seen = [(i, 0, c, 4, 0.1, 0.1 * (1 + v) / (1 - v), 0.0) for i, cs in value.items() for c, v in cs.items()]
    pixels_ = spark.createDataFrame(seen, "item_id int, row long, col int, scl int, b04 double, b08 double, vv double")
    cells = spark.createDataFrame([(r, 0, c) for r in (1, 2, 3) for c in range(4)], "request_id int, row long, col int")
    reach = spark.createDataFrame([(r, i) for r in (1, 2, 3) for i in value], "request_id int, item_id int")
    out = service.calculate(asked, scenes_, pixels_, cells, reach, ["NDVI"])
    assert {r["request_id"]: r["status"] for r in out.status.collect()} == {1: 200, 2: 404, 3: 200}
    got = {(r["request_id"], r["col"]): r for r in out.values.collect()}
    assert [got[1, c]["filled"] for c in range(4)] == [False, True, True, False]
    assert got[1, 0]["v"] == pytest.approx(0.6, abs=1e-4) and got[1, 2]["v"] == pytest.approx(0.3, abs=1e-4) and got[1, 3]["v"] is None
    assert got[1, 1]["v"] == pytest.approx(float((np.median([0.1 * 1.2 / 0.8, 0.1 * 1.4 / 0.6]) - 0.1) / (np.median([0.1 * 1.2 / 0.8, 0.1 * 1.4 / 0.6]) + 0.1)), abs=1e-4)
    picks = {r["request_id"]: r for r in out.picks.collect()}
    assert picks[1]["item_id"] == picks[3]["item_id"] == 10  # a scene of the day comes before the preferred provider's of another
    assert service.calculate(asked.limit(0), scenes_, pixels_, cells, reach, ["NDVI"]).values.count() == 0


def test_requests_that_ask_the_same_are_answered_once(spark):
    """Copies of requests and scenes that no page reaches add no pairs, and every request is answered as if it were alone."""
    from terrabrook.plans import requests as service

    box = lambda x: F.array(F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, 0), (x + 4, 0), (x + 4, 4)))))
    rows = [(i, "2024-02-01", "NDVI", "s2", (None, "aws", "both")[i % 3]) for i in range(60)] + [(100, "soon", "NDVI", "s2", None), (101, None, None, None, None), (102, None, None, None, None)]
    asked = spark.createDataFrame(rows, "request_id int, day string, index_name string, satellite string, provider string").withColumn("rings", F.when(F.col("request_id") % 2 == 0, box(0)).otherwise(box(2)))
    firsts, members = service.alike(asked)
    assert sorted(r["request_id"] for r in firsts.collect()) == [0, 1, 2, 3, 4, 5, 100, 101, 102]
    assert {r["request_id"]: r["_first"] for r in members.collect()} == {i: i if i > 99 else i % 6 for i, *_ in rows}
    scenes_ = spark.createDataFrame([(i, f"2024-02-{1 + i % 2:02d}T{i % 24:02d}:00:00", ("planetary", "aws")[i // 2 % 2], "sentinel-2-l2a") for i in range(200)], "item_id int, acquired string, provider string, collection string")
    scenes_ = scenes_.withColumn("acquired", F.col("acquired").cast("timestamp_ntz")).withColumn("rings", box(0))
    few = service.first_scenes(scenes_)
    assert few.count() == 4 * service.WIDE_PAGE
    pixels_ = scenes_.select("item_id", F.lit(0).cast("long").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col")).where(F.pmod(F.hash("item_id", "col"), F.lit(3)) > 0)
    pixels_ = pixels_.withColumns({"scl": F.lit(4), "b04": F.lit(0.1), "b08": 0.2 + F.col("item_id") / 400, "vv": F.lit(0.0)})
    cells = lambda r: r.select("request_id", F.lit(0).cast("long").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    reach = lambda r, s: r.select("request_id").join(s.select("item_id"))
    once = service.calculate(firsts, few, pixels_, cells(firsts), reach(firsts, few), ["NDVI"])
    alone = service.calculate(asked, scenes_, pixels_, cells(asked), reach(asked, scenes_), ["NDVI"])
    for a, b in zip(once, alone, strict=True):
        assert sorted(map(repr, service.of_members(a, members).collect())) == sorted(map(repr, b.collect()))
    assert once.picks.count() == 6 and alone.picks.count() == 60


def test_zoning_run_of_many_fields(spark):
    rng = np.random.default_rng(5)
    rows = [(g, r, c, *(float(x) for x in rng.normal(size=3))) for g, (h, w) in {3: (9, 12), 8: (6, 7)}.items() for r in range(h) for c in range(w)]
    maps = spark.createDataFrame(rows, "grid long, row long, col int, n double, p double, k double")
    got = sorted(map(tuple, analyses.zoning_run(maps, 3).drop("product").collect()))
    want = []
    for g in (3, 8):
        for nutrient in "NPK":
            alone = maps.where(f"grid = {g}").select("row", "col", F.col(nutrient.lower()).alias("v"))
            want += [(g, nutrient, *r) for r in analyses.variable_rates(alone, nutrient, 3).drop("product", "crop", "demand_kg_t").collect()]
    assert got == sorted(map(tuple, want)) and len(got) == 18
