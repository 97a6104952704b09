"""Overviews, warping, the clustered layout."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrabrook.operators import grid, pyramid, raster, tiles, warp
from terrabrook.sources import clustered


def array_of(rows, h, w):
    a = np.full((h, w), np.nan)
    for r, c, v in rows:
        a[r, c] = np.nan if v is None else v
    return a


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(8)
    return [(g, r, c, None if rng.random() < 0.1 else float(rng.normal())) for g, (h, w) in {1: (37, 29), 2: (8, 8)}.items() for r in range(h) for c in range(w)]


def means(rows, k):
    out = {}
    for g, r, c, v in rows:
        t = out.setdefault((g, r >> k, c >> k), [0.0, 0])
        if v is not None:
            t[0], t[1] = t[0] + v, t[1] + 1
    return out


def test_overviews_and_updates(spark, cells):
    df = spark.createDataFrame(cells, "g int, row long, col int, v double").repartition(3)
    levels = pyramid.overviews(df, 3, ["g"])
    changed = [(1, 5, 6, 100.0), (1, 36, 28, None), (2, 0, 0, -3.0)]
    other = {(g, r, c): v for g, r, c, v in cells} | {(g, r, c): v for g, r, c, v in changed}
    after = pyramid.updated(levels, spark.createDataFrame(changed, "g int, row long, col int, v double"), 3, ["g"])
    for table, rows in ((levels, cells), (after, [(*k, v) for k, v in other.items()])):
        got = {(r["level"], r["g"], r["row"], r["col"]): (r["total"], r["n"]) for r in table.collect()}
        want = {(k, *at): tuple(t) for k in range(4) for at, t in means(rows, k).items()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)
    assert dict(after.dtypes) == dict(levels.dtypes)
    assert pyramid.overviews(df.limit(0), 2, ["g"]).count() == 0


def test_decimated_reads_one_level(spark, cells):
    rows = [x for x in cells if x[0] == 1]
    levels = pyramid.overviews(spark.createDataFrame(rows, "g int, row long, col int, v double"), 3)
    assert [pyramid.level_for(37, 29, n, n, 3) for n in (29, 14, 7, 3, 1)] == [0, 1, 2, 3, 3]
    got = {(r["row"], r["col"]): r["v"] for r in pyramid.decimated(levels, 37, 29, 9, 7, 3).collect()}
    level = means(rows, 2)
    for i in range(9):
        for j in range(7):
            total, n = level[1, int((i + 0.5) * 37 / 9 / 4), int((j + 0.5) * 29 / 7 / 4)]
            assert got[i, j] == (pytest.approx(total / n) if n else None)


def bilinear(a, y, x):
    h, w = a.shape
    y0, x0, total, weight = int(np.floor(y)), int(np.floor(x)), 0.0, 0.0
    for p in (0, 1):
        for q in (0, 1):
            k = (y - y0 if p else 1 - (y - y0)) * (x - x0 if q else 1 - (x - x0))
            v = a[min(max(y0 + p, 0), h - 1), min(max(x0 + q, 0), w - 1)]
            if k > 0 and not np.isnan(v):
                total, weight = total + k * v, weight + k
    return total / weight if weight else None


@pytest.mark.parametrize("side", [256, 8])
def test_warping_within_a_zone(spark, monkeypatch, side):
    """Shifted and at another resolution, for two grids at once, whatever the tiles."""
    monkeypatch.setattr(tiles, "SIDE", side)
    rng = np.random.default_rng(1)
    rows = [(g, r, c, None if rng.random() < 0.1 else float(rng.normal())) for g in (1, 2) for r in range(30) for c in range(23)]
    df = spark.createDataFrame(rows, "g int, row long, col int, v double").repartition(4)
    source, target = warp.Frame(1000.0, 2000.0, 10.0, 32643, 30, 23), warp.Frame(963.0, 2021.0, 7.0, 32643, 50, 40)
    for nearest in (False, True):
        got = {(r["g"], r["row"], r["col"]): r["v"] for r in warp.warped(df, source, target, ["g"], nearest).collect()}
        for g in (1, 2):
            a = array_of([x[1:] for x in rows if x[0] == g], 30, 23)
            for i in range(50):
                for j in range(40):
                    y, x = (2000 - (2021 - (i + 0.5) * 7)) / 10 - 0.5, (963 + (j + 0.5) * 7 - 1000) / 10 - 0.5
                    if -0.5 <= y < 29.5 and -0.5 <= x < 22.5:
                        if nearest:
                            v = a[min(29, int(np.floor(y + 0.5))), min(22, int(np.floor(x + 0.5)))]
                            want = None if np.isnan(v) else v
                        else:
                            want = bilinear(a, y, x)
                        assert got.pop((g, i, j)) == (None if want is None else pytest.approx(want, abs=1e-12))
        assert not got


def test_warping_to_the_next_zone_and_back(spark):
    """A smooth surface survives the way to zone 44; cells lie where the projection says."""
    h, w = 60, 50
    cells = spark.range(h * w).select(F.floor(F.col("id") / w).alias("row"), (F.col("id") % w).cast("int").alias("col")).withColumn("v", F.col("row") * 3.0 + F.col("col") * 2.0)
    a, b = warp.Frame(700_000.0, 2_500_000.0, 500.0, 32643, h, w), warp.Frame(70_000.0, 2_520_000.0, 500.0, 32644, 120, 120)
    there = warp.warped(cells, a, b)
    assert there.count() > 2000
    east, north = F.lit(b.x0) + (F.col("col") + 0.5) * b.res_m, F.lit(b.y0) - (F.col("row") + 0.5) * b.res_m
    at = there.select("v", *(c.alias(n) for n, c in zip(("lon", "lat"), grid.from_utm(east, north, 32644))))
    e, n = grid.to_utm(F.col("lon"), F.col("lat"), 32643)
    rows = at.select("v", e.alias("e"), n.alias("n")).limit(400).collect()
    for r in rows:
        y, x = (a.y0 - r["n"]) / a.res_m - 0.5, (r["e"] - a.x0) / a.res_m - 0.5
        assert r["v"] == pytest.approx(3 * min(max(y, 0), h - 1) + 2 * min(max(x, 0), w - 1), abs=1e-6)
    assert warp.warped(cells.limit(0), a, b).where("v is not null").count() == 0


def test_morton_ranges():
    def key(r, c):
        return sum(((r >> i & 1) << (2 * i + 1)) | ((c >> i & 1) << (2 * i)) for i in range(12))

    rng = random.Random(4)
    for most in (1, 3, 32, 10_000):
        for _ in range(25):
            r, c, h, w = rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 40), rng.randint(1, 40)
            ranges = clustered.window_ranges(r, c, h, w, most)
            assert len(ranges) <= most and ranges == sorted(ranges) and all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
            keys = {key(i, j) for i in range(r, r + h) for j in range(c, c + w)}
            covered = sum(b - a + 1 for a, b in ranges)
            assert all(any(a <= k <= b for a, b in ranges) for k in keys) and (most < 10_000 or covered == len(keys))
    assert clustered.window_ranges(3, 3, 0, 5) == []


def test_a_window_reads_little(spark, tmp_path):
    n = 512
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).cast("int").alias("col"), F.rand(3).alias("v"))
    clustered.write_clustered(cells, f"{tmp_path}/t", 4)
    assert {r["row"]: r["key"] for r in spark.read.parquet(f"{tmp_path}/t").where("col = 0 and row in (1, 2, 3)").collect()} == {1: 2, 2: 8, 3: 10}
    part = clustered.read_window(spark, f"{tmp_path}/t", 100, 37, 40, 50)
    got = {(r["row"], r["col"]): r["v"] for r in part.collect()}
    want = {(r["row"], r["col"]): r["v"] for r in raster.window(cells, 100, 37, 40, 50).collect()}
    assert got == want
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "Or(" in plan.split("PushedFilters: [")[1]
    scans, todo = [], [part._jdf.queryExecution().executedPlan()]
    part._jdf.collectToPython()
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan") or "Scan parquet" in p.nodeName():
            scans.append(p.metrics().apply("numOutputRows").value())
        if p.nodeName() == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert scans and 2000 <= sum(scans) < n * n / 8
    assert clustered.read_window(spark, f"{tmp_path}/t", -5, 500, 10, 40).count() == 5 * 12


@pytest.mark.parametrize(("h", "w", "rows", "cols", "side"), [(20, 31, 20, 31, 8), (40, 30, 13, 10, 8), (9, 7, 20, 33, 16), (16, 16, 4, 4, 256)])
def test_map_tiles(spark, h, w, rows, cols, side):
    from terrabrook.operators import maps

    rng = np.random.default_rng(h)
    images = {g: rng.integers(0, 256, (h, w, 4)) for g in (1, 2)}
    for image in images.values():
        image[rng.random((h, w)) < 0.3, 3] = 0
    data = [(g, r, c, *map(int, image[r, c])) for g, image in images.items() for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(data, "g int, row long, col int, r int, g_ int, b int, a int").withColumnsRenamed({"g": "map", "g_": "g"})
    made = maps.map_tiles(cells.repartition(3), h, w, rows, cols, ["map"], side)
    assert made.count() == 2 * -(-rows // side) * -(-cols // side)
    got = {}
    for p in maps.pixels_of(made, ["map"], side).collect():
        got[p["map"], p["row"], p["col"]] = [p[k] for k in "rgba"]
    for g, image in images.items():
        want = maps.resampled(image.astype(float), maps.weights(0, rows, h / rows, 0, h, h), maps.weights(0, cols, w / cols, 0, w, w))
        if (h, w) == (rows, cols):
            assert (want[image[..., 3] > 0] == image[image[..., 3] > 0]).all() and (want[..., 3] == image[..., 3]).all()
        assert all(got.pop((g, i, j)) == want[i, j].tolist() for i in range(rows) for j in range(cols))
    assert not got
    png = bytearray(made.first()["png"])
    png[40] ^= 1
    with pytest.raises(ValueError):
        maps.read_png(bytes(png))


def test_png_filters_and_opacity():
    from terrabrook.operators import maps

    rng = np.random.default_rng(2)
    ramp = np.stack([np.add.outer(np.arange(50), np.arange(40))] * 4, 2).astype(np.uint8)
    for image in (ramp, rng.integers(0, 256, (17, 9, 4)).astype(np.uint8), np.zeros((3, 1, 4), np.uint8), (ramp.astype(int) ** 2 // 7 % 256).astype(np.uint8)):
        assert (maps.read_png(maps.write_png(image)) == image).all()
    assert len(maps.write_png(ramp)) < ramp.size / 10
    half = np.zeros((8, 8, 4))
    half[:, :4] = (200, 10, 30, 255)
    half[:, 4:] = (0, 255, 0, 0)  # transparent green lends no colour
    out = maps.resampled(half, maps.weights(0, 2, 4, 0, 8, 8), maps.weights(0, 2, 4, 0, 8, 8))
    assert (np.abs(out[:, :, :3].astype(int)[out[..., 3] > 0] - [200, 10, 30]) <= 1).all() and out[0, 0, 3] > out[0, 1, 3]


def test_raster_files(spark, tmp_path):
    from terrabrook.sources import tiff

    rng = np.random.default_rng(6)
    h, w = 70, 45
    a = rng.normal(size=(h, w))
    a[rng.random((h, w)) < 0.2] = np.nan
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)]
    cells = spark.createDataFrame(rows, "row long, col int, v double").repartition(3)
    frame = warp.Frame(500_000.0, 2_000_000.0, 10.0, 32644, h, w)
    assert tiff.write_raster(cells, f"{tmp_path}/t", frame, 32, 16) == 6
    got = {(r["row"], r["col"]): r["v"] for r in tiff.read_raster(spark, f"{tmp_path}/t", 2).collect()}
    assert got == {(r, c): v for r, c, v in rows}
    part = tiff.read_raster(spark, f"{tmp_path}/t").where("row >= 30 and row < 40 and col = 17")
    assert sorted(r["row"] for r in part.collect()) == list(range(30, 40))
    with open(f"{tmp_path}/t/block_32_0.tif", "rb") as f:
        raw = f.read()
    assert raw[:4] == b"II*\0"
    import pyarrow as pa

    tags = tiff.directory(pa.PythonFile(__import__("io").BytesIO(raw), "r"))
    assert tags[tiff.WIDTH] == (32,) and tags[tiff.TIE_POINT][3:5] == (500_000.0, 2_000_000.0 - 320) and tags[tiff.GEO_KEYS][-1] == 32644 and len(tags[tiff.TILE_OFFSETS]) == 4
    assert tiff.write_raster(cells.limit(0), f"{tmp_path}/none", frame) == 0


def test_raster_filters_rule_out_tiles(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    from terrabrook.sources import tiff

    cells = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.rand(1).alias("v"))
    tiff.write_raster(cells, f"{tmp_path}/t", warp.Frame(0.0, 0.0, 1.0, 32643, 64, 64), 32, 8)
    every = tiff.Reader(f"{tmp_path}/t", 4)
    assert sum(len(p.tiles) for p in every.partitions()) == 64 and len(every.partitions()) == 16
    few = tiff.Reader(f"{tmp_path}/t", 4)
    filters = [GreaterThanOrEqual(("row",), 10), LessThan(("row",), 20), EqualTo(("col",), 40)]
    assert list(few.pushFilters(filters)) == filters
    assert sorted((t[2], t[3]) for p in few.partitions() for t in p.tiles) == [(8, 40), (16, 40)]
    plan = tiff.read_raster(spark, f"{tmp_path}/t").where("row >= 10 and col = 40")
    assert plan.count() == 54


def test_dissolving_broadcasts_no_table_of_cells(spark):
    cells = spark.createDataFrame([(0, r, c, 1 + (r * r + c) % 3) for r in range(20) for c in range(20)], "grid long, row long, col int, z int")
    out = raster.dissolved(cells, 5)
    plan = out._jdf.queryExecution().executedPlan()
    assert out.count() == 400
    plan.execute().count()
    assert "SortMergeJoin" in plan.toString() and "BroadcastHashJoin" not in plan.toString()
