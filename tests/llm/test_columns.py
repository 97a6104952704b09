"""Columns of the caller that bear the names which operators use inside."""

import pytest
from pyspark.sql import functions as F

from terrabrook.llm import jaccard_join, mixing, mpeg_audio, pii, sharding, toxicity

NAMES = ["_id", "_found", "_done", "_row", "_text", "_n", "_h", "_key", "_of", "_k", "_each", "_gaps", "_tried", "_salt", "_place", "_copy", "toxicity", "toxic_spans", "MEDIA", "node", "root", "shard", "n", "copies", "size", "Replaced", "a.b"]
TEXTS = ["one two three four five six", "mail me at ann@example.org or 4111111111111111", "you moron of a scumbag", "", None, "one two three four five six"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def rows():
    return [(i if i != 3 else None, t, "en", ["s", None, "t"][i % 3], 1, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "en", None, 1, *(f"{n}1" for n in NAMES))]


def marks(spark):
    return spark.createDataFrame([(i, int(i == 2)) for i in range(6)], "doc_id long, toxic int")


STEPS = {
    "toxicity": lambda spark, df: toxicity.drop_toxic(df, marks(spark)),
    "jaccard": lambda spark, df: jaccard_join.one_of_each(df),
    "pii": lambda spark, df: pii.pseudonymise(df, "k").drop("replaced") if "Replaced" not in df.columns else pii.pseudonymise(df.drop("Replaced"), "k").drop("replaced"),
    "mix": lambda spark, df: mixing.apply_mix(df),
    "audio": lambda spark, df: mpeg_audio.store_text(df.drop("MEDIA")).drop("media"),
}


@pytest.mark.parametrize("step", STEPS)
def test_all_columns_are_kept(spark, rows, step):
    df = spark.createDataFrame(rows, KIND)
    out = STEPS[step](spark, df)
    names = [c for c in df.columns if c in out.columns]
    assert len(names) >= len(df.columns) - 1 and out.columns == names
    by = {r["_id"]: tuple(r[c] for c in names if c != "text") for r in df.collect()}
    got = [r for r in out.collect()]
    assert got and all(tuple(r[c] for c in names if c != "text") == by[r["_id"]] for r in got)
    assert STEPS[step](spark, df.limit(0)).count() == 0


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "x", "kept")], "doc_id long, text string, MEDIA string")
    with_media = mpeg_audio.store_text(df)
    assert with_media.columns == ["doc_id", "text", "MEDIA", "media"] and with_media.toArrow().column("MEDIA").to_pylist() == ["kept"]
    scored = toxicity.score_toxicity(df.withColumnRenamed("MEDIA", "TOXICITY"), toxicity.Field())
    assert scored.columns == ["doc_id", "text", "TOXICITY", "toxicity", "toxic_spans"]


def test_digests_with_such_columns(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    assert jaccard_join.jaccard_components(df.where("doc_id is not null").dropDuplicates(["doc_id"])).count() == 5
    assert mixing.mix_sources(df).count() == 7
    assert sharding.shard_documents(df).count() == 7
    assert mpeg_audio.media_digest(df).count() == 7


def test_free_names():
    from terrabrook.llm.common import free_name

    assert free_name("x", ["y"]) == "x" and free_name("x", ["X", "x_"]) == "x__"
