"""Choosing scenes: search, fallbacks, best per date, even samples, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import meets
from .quality import finite


def search(scenes: DataFrame, start: str | None = None, end: str | None = None, collections: Sequence[str] | None = None, page: int | None = None) -> DataFrame:
    """Scenes from start to the end of day `end` in the given collections; page: the first so many by time and identifier."""
    out = scenes
    if start and end and start > end:
        raise ValueError("start must not be after end")
    if start:
        out = out.where(F.col("acquired") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        out = out.where(F.col("acquired") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    if collections:
        out = out.where(F.col("collection").isin(*collections))
    return out.orderBy("acquired", "item_id").limit(page) if page else out


def on_day(scenes: DataFrame, day: str, limit: int = 6) -> DataFrame:
    return search(scenes, day, day, page=limit)


def newest(scenes: DataFrame, n: int = 1) -> DataFrame:
    """The n latest scenes, the smaller identifier of equals first."""
    return scenes.orderBy(F.desc("acquired"), "item_id").limit(n)


def intersecting(scenes: DataFrame, rings: Sequence[Sequence[tuple[float, float]]], footprint: str = "footprint") -> DataFrame:
    """Scenes whose footprint (array of structs x, y; closed or not) meets a polygon: bounding boxes first, then edges that cross or one shape within the other."""
    xs, ys = [p[0] for ring in rings for p in ring], [p[1] for ring in rings for p in ring]
    across, along = F.transform(footprint, lambda p: p["x"]), F.transform(footprint, lambda p: p["y"])
    box = (F.array_min(across) <= max(xs)) & (F.array_max(across) >= min(xs)) & (F.array_min(along) <= max(ys)) & (F.array_max(along) >= min(ys))
    return scenes.where(box).where(meets(F.col(footprint), rings))


def first_tier(rows: DataFrame, tier: Column) -> DataFrame:
    """The rows of the lowest tier that has any: fallbacks between providers, cloud limits or date windows as one plan. Null tiers go."""
    tagged = rows.withColumn("_tier", tier).where("_tier is not null")
    lowest = tagged.agg(F.min("_tier").alias("_tier"))
    return tagged.join(F.broadcast(lowest), "_tier").drop("_tier")  # one row


def provider_fallback(scenes: DataFrame, order: Sequence[int]) -> DataFrame:
    """All rows of the first provider in order that has any."""
    tier = F.lit(None).cast("int")
    for k, provider in reversed(list(enumerate(order))):
        tier = F.when(F.col("provider") == provider, k).otherwise(tier)
    return first_tier(scenes, tier)


def cloud_ladder(scenes: DataFrame, start: str, end: str, limits: Sequence[float] = (20, 100), widen: int = 30) -> DataFrame:
    """Scenes under the first cloud limit that leaves any, else those of a wider window under the last limit."""
    day = F.to_date("acquired")
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    near = day.between(F.date_sub(F.lit(start).cast("date"), widen), F.date_add(F.lit(end).cast("date"), widen))
    tier = F.when(near & (F.col("cloud") < limits[-1]), len(limits))
    for k, most in reversed(list(enumerate(limits))):
        tier = F.when(inside & (F.col("cloud") < most), k).otherwise(tier)
    return first_tier(scenes, tier)


def date_window(scenes: DataFrame, day: str, days: int = 14) -> DataFrame:
    """Scenes of the day; if there are none, those up to so many days before or after."""
    apart = F.abs(F.date_diff(F.to_date("acquired"), F.lit(day).cast("date")))
    return first_tier(scenes, F.when(apart == 0, 0).when(apart <= days, 1))


def known_cloud(cloud: Column, zero_is_missing: bool = True) -> Column:
    """Cloud cover; a zero counts as unknown unless told otherwise."""
    return F.nullif(cloud, F.lit(0.0)) if zero_is_missing else cloud


def availability(scenes: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """(day, cloud_cover): the least known cloud cover of each day."""
    return scenes.groupBy(F.to_date("acquired").alias("day")).agg(F.min(known_cloud(F.col("cloud"), zero_is_missing)).alias("cloud_cover"))


def best_per_date(scenes: DataFrame) -> DataFrame:
    """The least cloudy scene of each day, unknown cover last, ties to the smaller identifier."""
    w = Window.partitionBy("day").orderBy(F.coalesce(known_cloud(F.col("cloud")), F.lit(999.0)), "item_id")
    return scenes.withColumn("day", F.to_date("acquired")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def points(n: int | None, least: int = 8, most: int = 16) -> int:
    return max(least, min(n or least, most))


def even_sample(rows: DataFrame, by: str, n: int) -> DataFrame:
    """n rows evenly spaced in the order of a unique column, the first and the last among them. The column's values (of a series, its days) come together as one array; rows don't."""
    every = F.array_sort(F.collect_set(by))
    last = F.size("_all") - 1
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at("_all", F.bround(i * last / (n - 1)).cast("int") + 1))
    days = rows.agg(every.alias("_all")).select(F.explode(F.when(last < n, F.col("_all")).when(last >= n, wanted)).alias(by)).distinct()
    return rows.join(F.broadcast(days), by, "left_semi")  # n rows


def has_assets(assets: str, required: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys(assets))) == 0


def first_asset(assets: str, names: Sequence[str] = ("vv", "VV", "red", "B04", "B04.jp2", "B04.tif", "B04.TIF")) -> Column:
    """The address of the first of these assets that a scene has, else of its first asset by name; null without any."""
    address = lambda k: F.nullif(F.try_element_at(assets, k), F.lit(""))
    others = F.filter(F.transform(F.array_sort(F.map_keys(assets)), address), lambda h: h.isNotNull())
    return http_url(F.coalesce(*(address(F.lit(n)) for n in names), F.get(others, F.lit(0))))


def prefer_http(href: Column, alternates: Column) -> Column:
    """href as an https address; one of another scheme gives way to the first http(s) address among its alternates."""
    plain = http_url(href)
    other = F.get(F.filter(alternates, lambda a: a.rlike("^https?://")), F.lit(0))
    return F.when(plain.rlike("^https?://"), plain).otherwise(F.coalesce(other, plain))


def http_url(href: Column) -> Column:
    """s3://bucket/key as an https address; others as they are."""
    return F.when(href.startswith("s3://"), F.regexp_replace(href, r"^s3://([^/]+)/(.*)$", r"https://$1.s3.amazonaws.com/$2")).otherwise(href)


def crs_code(epsg: Column, code: Column) -> Column:
    """The EPSG number, or that of a text like EPSG:32643."""
    return F.coalesce(epsg.cast("int"), F.regexp_extract(code, r"(\d+)$", 1).try_cast("int"))


def keep_share(pixels: DataFrame, masked: Sequence[int], by: str = "scene_id") -> DataFrame:
    """(by, keep_pct): the share of a scene's pixels that have an NDVI and no masked class. pixels: every cell of the field, seen or not."""
    ndvi = F.expr("(b08 - b04) / nullif(b08 + b04, 0)")
    kept = finite(ndvi).isNotNull() & ~F.coalesce(F.col("scl").isin(*masked), F.lit(False))
    return pixels.groupBy(by).agg((F.count_if(kept) / F.greatest(F.count("*"), F.lit(1)) * 100).alias("keep_pct"))


def radar_share(pixels: DataFrame, by: str = "scene_id") -> DataFrame:
    """(by, keep_pct): the share of a scene's pixels with a valid backscatter."""
    return pixels.groupBy(by).agg((F.count_if((F.col("vv") > 0) & (F.col("vv") > -1000)) / F.greatest(F.count("*"), F.lit(1)) * 100).alias("keep_pct"))


def best_scenes(scored: DataFrame, n: int = 1, by: str = "scene_id") -> DataFrame:
    return scored.orderBy(F.desc("keep_pct"), by).limit(n)
