"""Polygons as a relation, against plain Python."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from terrabrook.operators import fields

RINGS = "rings array<array<struct<x:double,y:double>>>"


def crossed(rings, x, y):
    n = 0
    for ring in rings or []:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                n += 1
    return n % 2 == 1


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def star(rng, x, y, size, n):
    """A ring around (x, y), concave, some corners on whole numbers."""
    import math

    ring = []
    for i in range(n):
        r = size * rng.uniform(0.3, 1)
        p = (x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n))
        ring.append((float(round(p[0])), float(round(p[1]))) if rng.random() < 0.4 else p)
    return ring


@pytest.fixture(scope="module")
def polygons():
    rng = random.Random(11)
    out = []
    for i in range(60):
        x, y = rng.uniform(-10, 90), rng.uniform(-10, 70)
        rings = [star(rng, x, y, rng.choice([0.4, 2, 6, 15]), rng.randint(3, 9))]
        if i % 4 == 0:
            rings.append(star(rng, x, y, 1.5, 4))
        out.append((i, i % 2, rings))
    out.append((100, 0, [[(-500.0, -400.0), (700.0, -300.0), (650.0, 900.0), (20.5, 30.5), (-450.0, 800.0)]]))  # far larger than any tile
    out += [(101, 1, None), (102, 1, []), (103, 1, [[(1.0, 1.0)]]), (104, 0, [[(1.0, 1.0), (9.0, 9.0)]]), (105, 1, [[(2.0, 2.0)] * 5]), (106, 0, [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]])]
    return out


@pytest.mark.parametrize(("side", "levels"), [(4, 4), (16, 1), (1, 0), (64, 2)])
def test_cells_of_fields(spark, polygons, side, levels):
    df = spark.createDataFrame(polygons, f"id int, g int, {RINGS}").repartition(3)
    cells = [(g, r, c, float(r * 100 + c)) for g in (0, 1) for r in range(60) for c in range(80)]
    grid = spark.createDataFrame(cells, "g int, row long, col int, v double")
    want = {(i, r, c) for i, g, rings in polygons for k, r, c, _ in cells if k == g and crossed(rings, c + 0.5, r + 0.5)}
    met = fields.cells_of(grid, df, ["id"], "rings", F.col("col") + 0.5, F.col("row") + 0.5, ["g"], side, levels)
    assert set(met.columns) == {"g", "row", "col", "v", "id"}
    assert sorted((r["id"], r["row"], r["col"]) for r in met.collect()) == sorted(want)
    assert fields.cells_of(grid, df.limit(0), ["id"], "rings", "col", "row", ["g"]).count() == 0
    assert fields.cells_of(grid.limit(0), df, ["id"], "rings", "col", "row", ["g"]).count() == 0
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)


def test_inside_tiles_have_no_edges(spark, polygons):
    df = spark.createDataFrame([p for p in polygons if p[0] == 100], f"id int, g int, {RINGS}")
    tiles = fields.cover(df, ["id"], "rings", 16, 4).collect()
    rim = [t for t in tiles if t["_inside"] is None]
    assert len(rim) < len(tiles) / 4 and all(not t["_edges"] for t in tiles if t["_inside"]) and all(t["_edges"] for t in rim)
    rings = polygons[60][2]
    for t in tiles[::37]:
        if t["_inside"]:
            assert all(crossed(rings, (t["_tx"] + a) * 16, (t["_ty"] + b) * 16) for a in (0.01, 0.99) for b in (0.01, 0.99))
    assert len({(t["_tx"], t["_ty"]) for t in tiles}) == len(tiles)


def meets(a, b):
    def edges(rings):
        return [(p, q) for ring in rings or [] for p, q in zip(ring, [*ring[1:], ring[0]]) if p != q]

    sign = lambda v: (v > 0) - (v < 0)
    turn = lambda p, q, r: sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    ea, eb = edges(a), edges(b)
    if len(ea) < 3 or len(eb) < 3:
        return False
    for p, q in ea:
        for r, s in eb:
            apart = any(max(p[k], q[k]) < min(r[k], s[k]) or max(r[k], s[k]) < min(p[k], q[k]) for k in (0, 1))
            if not apart and turn(p, q, r) * turn(p, q, s) <= 0 and turn(r, s, p) * turn(r, s, q) <= 0:
                return True
    return crossed(b, *ea[0][0]) or crossed(a, *eb[0][0])


@pytest.mark.parametrize(("size", "pairs"), [(64.0, 1_000_000), (64.0, 5), (3.0, 50)])
def test_polygons_meet_polygons(spark, polygons, size, pairs):
    rng = random.Random(2)
    crowd = [(200 + i, 0, [star(rng, 33 + rng.random(), 21 + rng.random(), 0.3, 5)]) for i in range(30)]
    right = [(1000 + i, 0, [star(rng, rng.uniform(0, 80), rng.uniform(0, 60), rng.choice([1, 8]), 5)]) for i in range(60)] + [(2000 + i, 0, r) for i, _, r in crowd] + [(3000, 0, None)]
    left = [p for p in polygons if p[0] != 100] + crowd
    a, b = (spark.createDataFrame(p, f"{k} int, g int, {RINGS}").repartition(3) for p, k in ((left, "id"), (right, "other")))
    want = sorted((i, j) for i, _, p in left for j, _, q in right if meets(p, q))
    met = fields.meeting(a, b, ("id", "other"), ("rings", "rings"), size, pairs)
    assert sorted(map(tuple, met.collect())) == want and len(want) > 300
    assert "NestedLoop" not in plan(met) and "Cartesian" not in plan(met)
    assert fields.meeting(a.limit(0), b, ("id", "other"), ("rings", "rings")).count() == 0


def test_crowded_tiles_are_quartered(spark):
    rng = random.Random(6)
    rows = [(i, [star(rng, 100 + 30 * rng.random(), 100 + 30 * rng.random(), 0.5, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, f"id int, {RINGS}")
    left, right = fields.candidates(df, df, ("id", "id"), ("rings", "rings"), 64.0, 400)
    n = left.groupBy("_size", "_tx", "_ty").count().agg(F.max("count")).first()[0]
    assert n < 60 and left.agg(F.min("_size")).first()[0] < 64


def test_equal_polygons_are_tested_once(spark):
    """Copies go to the tiles as one polygon and all get its pairs; polygons of more edges than are carried along meet like others."""
    rng = random.Random(9)
    kinds = [[star(rng, 20, 20, 6, 5)], [star(rng, 24, 21, 6, 90)], [star(rng, 70, 70, 3, 4)], [star(rng, 19, 19, 2, 200)]]
    left = [(i, kinds[i % 4]) for i in range(200)] + [(900, None)]
    right = [(i, kinds[(i + 1) % 4]) for i in range(100)] + [(901, [[(float("nan"), 0.0), (9.0, 0.0), (9.0, 9.0)]])]
    a, b = (spark.createDataFrame(p, f"{k} int, {RINGS}").repartition(3) for p, k in ((left, "id"), (right, "other")))
    shapes, members = fields.different(a, "id", "rings")
    assert sorted(r["_key"] for r in shapes.collect()) == [0, 1, 2, 3] and members.count() == 200
    want = sorted((i, j) for i, p in left for j, q in right if j < 900 and meets(p, q))
    assert sorted((i, j) for i, j in map(tuple, fields.meeting(a, b, ("id", "other"), ("rings", "rings"), 16.0, 20).collect()) if j < 900) == want and len(want) >= 5000


def test_tiles_of_the_polygons_size_are_not_quartered(spark):
    """In a crowded place tiles stop at about the polygons' size: quarters of those would have copies of nearly all."""
    rng = random.Random(4)
    rows = [(i, [star(rng, 100 + rng.random(), 100 + rng.random(), 20, 5)]) for i in range(20)]
    a, b = (spark.createDataFrame(rows, f"{k} int, {RINGS}") for k in ("id", "other"))
    left, right = fields.candidates(a, b, ("id", "other"), ("rings", "rings"), 64.0, 50)
    assert left.count() <= 400 and right.count() <= 400
    want = sorted((i, j) for i, p in rows for j, q in rows if meets(p, q))
    assert sorted(map(tuple, fields.meeting(a, b, ("id", "other"), ("rings", "rings"), 64.0, 50).collect())) == want


def test_pairs_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(i, [star(rng, rng.uniform(0, 60), rng.uniform(0, 60), 9, 5)]) for i in range(80)]
    a, b = (spark.createDataFrame(rows, f"{k} int, {RINGS}") for k in ("id", "other"))
    above = plan(fields.meeting(a, b, ("id", "other"), ("rings", "rings"))).split("MapInArrow")
    assert len(above) == 2 and "Exchange" not in above[0] and "Join" not in above[0]


def test_lists_are_short():
    """No row stands for very many pairs, since explode holds them all."""
    i, n = fields.np.array([0] * 900 + [1] * 5 + [2] * 300), fields.np.array([1] * 905 + [64] * 300)
    runs = fields._runs(i, n)
    ends = [*runs[1:], len(i)]
    assert {0, 900, 905} <= set(runs.tolist()) and all(len(set(i[a:b])) == 1 and n[a:b].sum() <= fields.MET + 64 for a, b in zip(runs, ends))
    assert len(runs) < 90


@pytest.mark.parametrize("group", [7, 4096])
def test_copies_beyond_what_is_carried(spark, monkeypatch, group):
    """Polygons of few and of many copies meet those of few and of many, in groups of any size; a null key names nothing."""
    monkeypatch.setattr(fields, "KEYS", 3)
    monkeypatch.setattr(fields, "GROUP", group)
    rng = random.Random(12)
    kinds = [([star(rng, rng.uniform(15, 45), rng.uniform(15, 45), 6, rng.choice([4, 5, 9, 80]))], rng.choice([1, 2, 3, 13])) for _ in range(40)]
    dealt = lambda some: [(f"k{n}", p) for n, p in enumerate(p for p, n in some for _ in range(n))]
    left, right = dealt(kinds[:25]), dealt(kinds[15:])
    a, b = (spark.createDataFrame([*p, (None, p[0][1])], f"{k} string, {RINGS}").repartition(3) for p, k in ((left, "id"), (right, "other")))
    want = sorted((i, j) for i, p in left for j, q in right if meets(p, q))
    assert sorted(map(tuple, fields.meeting(a, b, ("id", "other"), ("rings", "rings"), 16.0, 30).collect())) == want and len(want) > 300


def test_equal_fields_are_covered_once(spark, tmp_path, monkeypatch):
    """Of equal fields one meets the cells, and all have its mean."""
    from terrabrook.plans import catalog

    orders = [(k + i * 997 * 23 * 2, c + 89 * i) for i in range(4) for k, c in ((3, 40), (10, 7), (16, 60))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(r, [r + c / 64 for c in range(64)]) for r in range(30)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked, cells_of = [], fields.cells_of
    monkeypatch.setattr(catalog.shapes, "cells_of", lambda cells, df, *a, **k: asked.append(df.count()) or cells_of(cells, df, *a, **k))
    got = {r["field"]: (r["n"], r["mean"]) for r in catalog.fields_cells(spark, str(tmp_path)).collect()}
    assert asked == [3] and len(got) == 12
    assert all(got[k] == got[k % (997 * 23 * 2)] for k in got)
