import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrabrook.llm import sharding

KIND = "doc_id long, text string, source string, size int, shard string, _h int"


def rows_of(n=500):
    rng = random.Random(5)
    rows = [(i, f"text {i} é", rng.choice(["big", "big", "big", "mid", None, "s" + str(i % 9)]), 1, "keep", 2) for i in range(n)]
    return rows + [(None, None, None, 0, None, 0)] * 7 + [(3, "", "mid", 0, "", 0)] * 30 + [(None, "x", "big", 0, "", 0), (4, "text 4 é", "1", 0, "", 0)]


def brute(spark, rows, shards, seed=23):
    """The same by plain sorting; the hash alone is Spark's."""
    df = spark.createDataFrame(rows, KIND)
    hashed = df.select("doc_id", "text", "source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), sharding._key("source")), F.lit(1 << 32)).alias("u")).collect()
    by = {}
    for d, t, s, h, u in hashed:
        by.setdefault("1" if s is None else "0" + s, []).append((h, d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), u, d, s))
    out = []
    for key, rs in by.items():
        for k, r in enumerate(sorted(rs)):
            out.append(((k + r[5] / 2**32) / len(rs), key, k, (r[6], r[7], r[3], r[4])))
    out.sort(key=lambda x: x[:3])
    base, more = divmod(len(out), shards)
    sizes = [base + (i < more) for i in range(shards)]
    places = [(i, j) for i, n in enumerate(sizes) for j in range(n)]
    return sorted(((*r[3], *p) for r, p in zip(out, places)), key=str)


@pytest.mark.parametrize(("shards", "copies"), [(16, 4096), (7, 4), (1000, 4096), (1, 4096)])
def test_against_brute_force(spark, monkeypatch, shards, copies):
    monkeypatch.setattr(sharding, "COPIES", copies)
    rows = rows_of()
    got = sharding.shard_documents(spark.createDataFrame(rows, KIND).repartition(4), shards)
    assert got.columns == ["doc_id", "source", "size", "text_crc32", "shard", "slot"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(spark, rows, shards)


def test_every_shard_has_the_mixture(spark):
    rows = rows_of(2000)
    got = sharding.shard_documents(spark.createDataFrame(rows, KIND), 16).collect()
    counts, share = Counter(r["shard"] for r in got), Counter(r["source"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    for shard, n in counts.items():
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(n))
        for source, m in share.items():
            have = sum(r["shard"] == shard and r["source"] == source for r in got)
            assert abs(have - m * n / len(got)) < 2


def test_files_keep_all_columns(spark, tmp_path):
    rows = rows_of(100)
    docs = spark.createDataFrame(rows, KIND)
    assert sharding.write_shards(docs.repartition(3), f"{tmp_path}/shards", 4) == ["shard_", "slot"]
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((tuple(r) for r in back.select(*docs.columns).collect()), key=str) == sorted(rows, key=str)
    places = Counter(r["shard_"] for r in back.collect())
    assert max(places.values()) - min(places.values()) <= 1
    one = spark.read.parquet(f"{tmp_path}/shards/shard_=2").withColumn("f", F.input_file_name()).collect()
    assert [r["slot"] for r in sorted(one, key=lambda r: (r["f"], r["slot"]))] == list(range(places[2]))


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], KIND)
    assert sharding.shard_documents(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_documents(empty, 0)
