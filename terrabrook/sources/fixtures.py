"""The driver's tables as scenes, pixels and a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Band expressions over lineitem; they hold in any SQL.
BANDS = {
    "b02": "0.02 + l_tax", "b03": "0.03 + l_discount", "b04": "l_quantity / 250", "b05": "0.05 + l_quantity / 300", "b08": "l_extendedprice / 150000", "b8a": "l_extendedprice / 150000 * 1.05",
    "b11": "0.05 + l_quantity / 200 + l_discount", "b12": "0.04 + l_quantity / 260 + l_tax", "vv": "l_extendedprice / 1000000", "vh": "l_quantity / 10000",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, order_id, line, acquired, scl, bands): one row for a cell of a scene."""
    rows = table(spark, sf_dir, "lineitem")
    bands = [F.expr(f"cast({sql} as double)").alias(b) for b, sql in BANDS.items()]
    return rows.select(F.col("l_suppkey").alias("scene_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("acquired"), (F.col("l_linenumber") + 4).alias("scl"), *bands)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, acquired, collection, provider, cloud, k): a catalogue row for each event."""
    rows = table(spark, sf_dir, "events")
    cloud = F.when(F.col("event_id") % 50 == 0, 0.0).when(F.col("value") <= 100, F.col("value"))
    return rows.select(F.col("event_id").alias("item_id"), F.col("ts").alias("acquired"), F.col("event_type").alias("collection"), (F.col("user_id") % 2).cast("int").alias("provider"), cloud.alias("cloud"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, v): a grid of one row for each vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    return rows.select(F.col("vec_id").alias("row"), "col", F.col("v").cast("double").alias("v"))


#: The same views for another engine's SQL.
_BAND_SQL = ", ".join(f"CAST({sql} AS DOUBLE) AS {b}" for b, sql in BANDS.items())
PIXELS_SQL = f"pixels AS (SELECT l_suppkey AS scene_id, l_orderkey AS order_id, l_linenumber AS line, l_shipdate AS acquired, l_linenumber + 4 AS scl, {_BAND_SQL} FROM lineitem)"
SCENES_SQL = "scenes AS (SELECT event_id AS item_id, ts AS acquired, event_type AS collection, CAST(user_id % 2 AS INTEGER) AS provider, CASE WHEN event_id % 50 = 0 THEN 0.0 WHEN value <= 100 THEN value END AS cloud, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)"
RASTER_SQL = "raster AS (SELECT vec_id AS \"row\", CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
