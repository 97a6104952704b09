import math

import numpy as np

from terrabrook.llm import knn_join
from terrabrook.llm.knn_join import F


def brute(rows, k):
    whole = lambda x: max(-(2**63), min(2**63 - 1024, math.floor(64 * float(x))))
    wrapped = lambda s: (s + 2**63) % 2**64 - 2**63
    ok = sorted({(i, tuple(map(whole, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i in sorted({i for i, _ in ok if i % 20 == 0}):
        best = sorted((-wrapped(sum(a * b for a, b in zip(q, v))), j) for n, q in ok if n == i for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    return sorted(map(tuple, knn_join.knn_join(df.repartition(4), F.col("id") % 20 == 0, k).collect()))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "SLICE", 150)
    monkeypatch.setattr(knn_join, "CHUNK", 7)
    monkeypatch.setattr(knn_join, "COPY", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(12)] + 0.1 * rng.normal(size=8)]) for i in range(900)]
    rows += [(int(i), rows[7][1]) for i in range(1000, 1400)]  # a hot vector
    rows += [(2000 + i, [float(rng.integers(-1, 2)) for _ in range(8)]) for i in range(200)]  # ties
    rows += [(3000, None), (3020, [1.0, None] * 4), (3040, [float("nan")] * 8), (3060, [float("inf")] * 8), (3080, [1.0] * 3), (None, [1.0] * 8), (3100, []), (3120, [1e6] * 8), (3120, [1e6] * 8)]
    assert run(spark, rows) == brute(rows, 20)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 20)
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []


def test_one_identifier_with_several_vectors(spark, monkeypatch):
    """Its own rows don't take the places of others."""
    rows = [(20, [float(i), 9.0]) for i in range(5)] + [(1, [1.0, 1.0]), (2, [0.5, 1.0]), (3, [-1.0, 2.0])]
    assert run(spark, rows, 3) == brute(rows, 3)
    rng = np.random.default_rng(7)
    monkeypatch.setattr(knn_join, "COPY", 0)
    own = [(20, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(700)] + [(int(i), [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(100, 400)]
    assert run(spark, own, 5) == brute(own, 5)
    many = [(int(i % 40), [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(400)]
    assert run(spark, many, 5) == brute(many, 5)


def test_lengths_meet_only_their_like(spark):
    rows = [(i, [float(i % 7), 1.0, -1.0][: 2 + i % 2]) for i in range(60)]
    assert run(spark, rows, 4) == brute(rows, 4)


def test_saturated_components(spark):
    rows = [(0, [-1e30, 1.0]), (20, [1e30, 2.0]), (1, [-1e30, 0.0]), (2, [1.0, 1.0]), (3, [-512.0, 511.99])]
    got = knn_join._unpacked(knn_join._packed(np.array([[-(2**63), 1], [-32768, 32767], [32768, 0]])), 2)
    assert got.tolist() == [[-(2**63), 1], [-32768, 32767], [32768, 0]]
    assert {r[:1] + r[2:] for r in run(spark, rows) if r[0] == 0} == {r[:1] + r[2:] for r in brute(rows, 20) if r[0] == 0}


def test_bounds_leave_out_far_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = 40 * rng.normal(size=(10, 6))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 10] + 0.01 * rng.normal(size=6)]) for i in range(3000)]
    monkeypatch.setattr(knn_join, "COPY", 0)
    seen = []
    real = knn_join._solved
    monkeypatch.setattr(knn_join, "_solved", lambda units, dim, k: seen.append(units.where("not asked").groupBy("g").count().agg(F.avg("count")).first()[0]) or real(units, dim, k))
    assert run(spark, rows, 5) == brute(rows, 5)
    assert seen[0] < 2000


def test_identifiers_with_a_stride_share_slices(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "SLICE", 100)
    rng = np.random.default_rng(9)
    rows = [(int(i) * 40, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(1200)]
    seen = []
    real = knn_join._solved
    monkeypatch.setattr(knn_join, "_solved", lambda units, dim, k: seen.append(units.where("not asked").groupBy("g", "slice").count().agg(F.max("count"), F.avg("count")).first()) or real(units, dim, k))
    assert run(spark, rows, 3) == brute(rows, 3)
    assert seen[0][0] < 2 * seen[0][1]
