import os
import time

from pyspark.sql import functions as F

from terrabrook.operators import cache


def source(spark, path, n=10):
    spark.range(n).withColumn("v", F.col("id") * 2).write.mode("overwrite").parquet(str(path))
    return lambda: spark.read.parquet(str(path)).where("v > 4").groupBy((F.col("id") % 3).alias("k")).agg(F.sum("v").alias("s"))


def kept(df):
    return all("/terrabrook/cache/" in f for f in df.inputFiles()) and len(df.inputFiles()) > 0


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_second_request_reads_no_input(spark, tmp_path):
    ask = source(spark, tmp_path / "t")
    first = cache.cached(ask(), {"index": "NDVI"})
    second = cache.cached(ask(), {"index": "NDVI"})
    assert rows(first) == rows(second) == rows(ask())
    assert kept(first) and second.inputFiles() == first.inputFiles()
    assert cache.cached(ask(), {"index": "EVI"}).inputFiles() != first.inputFiles()
    assert cache.cached(ask().where("k = 1"), {"index": "NDVI"}).inputFiles() != first.inputFiles()


def test_changed_input_and_old_entries_are_made_anew(spark, tmp_path):
    ask, now = source(spark, tmp_path / "t"), time.time()
    first = cache.cached(ask(), {}, 100.0, now=now)
    assert cache.cached(ask(), {}, 100.0, now=now + 99).inputFiles() == first.inputFiles()
    late = cache.cached(ask(), {}, 100.0, now=now + 101)
    assert late.inputFiles() != first.inputFiles() and rows(late) == rows(first)  # the old table is still there
    assert cache.cached(ask(), {}, 100.0, now=now + 102).inputFiles() == late.inputFiles()
    time.sleep(1.1)
    again = source(spark, tmp_path / "t", 20)
    changed = cache.cached(again(), {}, 100.0, now=now + 103)
    assert changed.inputFiles() != late.inputFiles() and rows(changed) == rows(again())


def test_one_of_several_writers_wins(spark, tmp_path, monkeypatch):
    ask, real = source(spark, tmp_path / "t"), cache._Files.names
    before = cache.cached(ask(), {"w": 1})
    monkeypatch.setattr(cache._Files, "names", lambda self, path: [])  # as if this one had looked before the other was done
    other = cache.cached(ask(), {"w": 1})
    assert other.inputFiles() == before.inputFiles()
    monkeypatch.setattr(cache._Files, "names", real)


def test_empty_results(spark, tmp_path):
    ask = source(spark, tmp_path / "t")
    none = lambda: ask().where("k > 100")
    assert cache.cached(none(), {}).count() == 0
    files, folder = cache._Files(spark), f"{cache.shared_dir(spark)}/terrabrook/cache/{cache.fingerprint(none(), {})}"
    assert not [n for n in files.names(folder) if n.endswith(".json")]
    assert cache.cached(none(), {}, keep_empty=True).count() == 0
    assert [n for n in files.names(folder) if n.endswith(".json")] == ["1.json"]


def test_sweeping(spark, tmp_path):
    ask, now = source(spark, tmp_path / "t"), time.time() + 1e7
    old = cache.cached(ask(), {"s": 1}, 10.0, now=now)
    new = cache.cached(ask(), {"s": 1}, 10.0, now=now + 50)
    assert cache.sweep(spark, 20.0, now + 55) >= 1
    assert kept(new) and rows(new) == rows(ask())
    assert not os.path.exists(old.inputFiles()[0].replace("file:", "").replace("//", "/"))
    cache.sweep(spark, 20.0, now + 1000)
    assert cache.cached(ask(), {"s": 1}, 10.0, now=now + 1001).inputFiles() != new.inputFiles()
