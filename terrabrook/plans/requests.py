"""The index service over a table of requests, from geometry, date, satellite and provider to the values of each field's cells, as one plan.

A request is a row (request_id, day, index_name, satellite, provider), its field the relation of cells (request_id, row, col) that `fields.cells_of` gives, and the scenes that show a
part of it the pairs (request_id, item_id) of `fields.meeting`. Nothing depends on the number of requests: fallbacks are least tiers by request, pages are ranks by request.

1. Requests whose date, index or satellite won't do are answered with a status and a reason.
2. Scenes of the day from the provider that is preferred, or else the other; without any, those of up to DAYS days before and after. The one that shows most of the field is picked.
3. The scenes of its day and collection are laid over one another: a cell takes the first, by time and identifier, that has all bands of the index.
4. Where less than LEAST of a field's cells have a value, the others take medians of up to TILES other scenes within DAYS days of the date, if all bands have one.
5. Clouds are masked; radar isn't.

Rows of requests with equal identifiers are one too many: they must be unique. A request without a field or a scene has status 404.

`alike` and `first_scenes` come before: requests that ask for the same in equal fields are answered once, and of scenes with the same footprint, day, provider and collection those that no page reaches
stay out. So the pairs of fields and scenes grow with the different ones of either, not with the requests times the scenes.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lookups
from ..functions.indices import ALIASES, REGISTRY, index_column, is_radar, lookup
from ..operators import legend, quality
from ..operators.scratch import saved

#: Days around the date, scenes of a page on the day and around it, scenes of a mosaic or a fill, share of cells below which a mosaic is filled.
DAYS, PAGE, WIDE_PAGE, TILES, LEAST = 14, 12, 24, 6, 0.7


class Answers(NamedTuple):
    """status: (request_id, status, detail); picks: (request_id, item_id, acquired, collection, keep_pct); values: (request_id, index_name, row, col, v, filled)."""

    status: DataFrame
    picks: DataFrame
    values: DataFrame


def canonical(name: Column) -> Column:
    """The name under which an index is registered."""
    plain = F.regexp_replace(F.upper(name), "[/ ]", "_")
    aliases = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def _of_index(each: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in each.items():
        out = F.when(F.col("index_name") == name, value).otherwise(out)
    return out


def judged(requests: DataFrame) -> DataFrame:
    """requests with `day` as a date, the canonical `index_name`, `radar`, `_prefer` (the provider asked first), `_named` (those that a fill asks), `status` and `detail` (null if they can be answered)."""
    indices = [n for family, n in REGISTRY if family == "calc"]
    radar_names = [n for n in indices if is_radar(n)]
    name, radar = canonical(F.col("index_name")), F.coalesce(F.lower("satellite"), F.lit("s2")).startswith("s1")
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.col("day").try_cast("date"))
    asked = F.lower(F.coalesce("provider", F.lit("both")))
    alone = F.lit(None).cast("string")
    for provider, names in lookups.PROVIDERS.items():
        alone = F.when(asked.isin(*names), provider).otherwise(alone)
    first, *others = lookups.provider_order("both")
    rows = requests.select("request_id", day.alias("day"), F.col("day").alias("_text"), name.alias("index_name"), radar.alias("radar"), F.when(radar, first).otherwise(F.coalesce(alone, F.lit(first))).alias("_prefer"), F.when(alone.isNotNull(), F.array(alone)).otherwise(F.array(*map(F.lit, [first, *others]))).alias("_named"))
    detail = (
        F.when(F.col("day").isNull(), "date must be YYYY-MM-DD")
        .when(F.col("index_name").isNull() | ~F.col("index_name").isin(*indices), F.concat(F.lit("Unsupported index: "), F.coalesce("index_name", F.lit("none"))))
        .when(F.col("radar") & ~F.col("index_name").isin(*radar_names), F.concat(F.lit("Index "), F.col("index_name"), F.lit(" is not available for Sentinel-1 (radar)")))
        .when(~F.col("radar") & F.col("index_name").isin(*radar_names), F.concat(F.lit("Index "), F.col("index_name"), F.lit(" requires Sentinel-1 (radar)")))
    )
    return rows.drop("_text").withColumn("detail", detail).withColumn("status", F.when(F.col("detail").isNotNull(), 400))


def _page(rows: DataFrame, tier: Column, most: Column | int) -> DataFrame:
    """Of each request's rows those of its lowest tier, the first `most` by time and identifier. Null tiers go."""
    by = Window.partitionBy("request_id")
    rows = rows.withColumn("_tier", tier).where("_tier is not null").withColumn("_least", F.min("_tier").over(by)).where("_tier = _least")
    return rows.withColumn("_n", F.row_number().over(by.orderBy("acquired", "item_id"))).where(F.col("_n") <= most).drop("_tier", "_least", "_n")


def alike(requests: DataFrame, rings: str = "rings") -> tuple[DataFrame, DataFrame]:
    """(firsts, members): of the requests that ask for the same in equal fields (`rings`) that of the least identifier, and (request_id, _first) of all of them."""
    asked = ["day", "index_name", "satellite", "provider", rings]
    same = F.struct(*asked).alias("_same")
    firsts = saved(requests.groupBy(*asked).agg(F.min("request_id").alias("request_id")), "asked")
    members = requests.select("request_id", same).join(firsts.select(F.col("request_id").alias("_first"), same), "_same").select("request_id", "_first")
    return firsts, saved(members, "members")


def of_members(answers: DataFrame, members: DataFrame) -> DataFrame:
    """What firsts are answered, for each request that asks for the same."""
    return answers.withColumnRenamed("request_id", "_first").join(members, "_first").select(*answers.columns)


def first_scenes(scenes: DataFrame, rings: str = "rings") -> DataFrame:
    """Scenes without those that can't be asked for: of equal footprints (`rings`), day, provider and collection a request has all or none in a tier, and a page ends after WIDE_PAGE by time and identifier."""
    by = Window.partitionBy(rings, F.to_date("acquired"), "provider", "collection").orderBy("acquired", "item_id")
    return scenes.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= WIDE_PAGE).drop("_n")


def _whole(bands: Sequence[str]) -> Column:
    out = F.lit(True)
    for b in bands:
        out = out & F.col(b).isNotNull()
    return out


def calculate(requests: DataFrame, scenes: DataFrame, pixels: DataFrame, cells: DataFrame, reach: DataFrame, indices: Sequence[str]) -> Answers:
    """What the requests ask for. scenes: (item_id, acquired, provider, collection); pixels: (item_id, row, col, scl, bands), one row a cell of a scene; indices: the canonical names that requests may ask for here."""
    names = list(dict.fromkeys(indices))
    bands = list(dict.fromkeys(b for n in names for b in lookup(n).bands))
    value, whole = (_of_index({n: f(n) for n in names}) for f in (index_column, lambda n: _whole(lookup(n).bands)))
    all_ = judged(requests)
    asked = all_.where(F.col("status").isNull() & F.col("index_name").isin(*names)).drop("status", "detail")
    kinds = F.when(F.col("radar"), F.col("collection").isin(*lookups.RADAR_COLLECTIONS)).otherwise(F.col("collection").isin(*lookups.OPTICAL_COLLECTIONS))
    met = reach.join(asked, "request_id").join(scenes.select("item_id", "acquired", "provider", "collection"), "item_id").where(kinds)
    rank = F.when(F.col("provider") == F.col("_prefer"), 0).when(F.col("provider").isin(*lookups.PROVIDERS), 1)
    met = saved(met.withColumns({"_apart": F.abs(F.date_diff(F.to_date("acquired"), F.col("day"))), "_rank": rank}).where(F.col("_apart") <= 2 * DAYS), "met")
    used = list(dict.fromkeys([*bands, "b04", "b08", "vv"]))
    sound = quality.stacked(pixels.select("item_id", "row", "col", "scl", *used).join(met.select("item_id").distinct(), "item_id", "left_semi"), used, ["item_id"])
    # the scene that shows most of the field
    near = F.when(F.col("_apart") == 0, F.col("_rank")).when(F.col("_apart") <= DAYS, F.col("_rank") + 2)
    chosen = _page(met, near, F.when(F.col("_apart") == 0, PAGE).otherwise(WIDE_PAGE))
    seen = chosen.join(cells, "request_id").join(sound, ["item_id", "row", "col"], "left")
    ndvi = F.expr("(b08 - b04) / nullif(b08 + b04, 0)").isNotNull() & ~F.coalesce(F.col("scl").isin(*lookups.CLOUDS_INDEX), F.lit(False))
    kept = seen.groupBy("request_id", "item_id", "acquired", "collection").agg((F.count_if(F.when(F.col("radar"), F.col("vv") > 0).otherwise(ndvi)) / F.count("*") * 100).alias("keep_pct"))
    best = kept.groupBy("request_id").agg(F.min_by(F.struct("item_id", "acquired", "collection", "keep_pct"), F.struct(-F.col("keep_pct"), "item_id")).alias("b")).select("request_id", "b.*")
    picks = saved(best, "picks")
    # the mosaic of its day
    of_best = met.join(picks.select("request_id", F.col("item_id").alias("_best"), F.col("acquired").alias("_when"), F.col("collection").alias("_from")), "request_id").where(F.col("collection") == F.col("_from"))
    tiles = _page(of_best.where(F.to_date("acquired") == F.to_date("_when")), F.col("_rank"), TILES)
    laid = tiles.join(cells, "request_id").join(sound, ["item_id", "row", "col"])
    first = F.min_by(F.struct(value.cast("double").alias("v"), "scl"), F.when(whole, F.struct("acquired", "item_id")))
    mosaic = laid.groupBy("request_id", "row", "col").agg(first.alias("m")).select("request_id", "row", "col", "m.v", "m.scl")
    base = saved(cells.join(picks.select("request_id"), "request_id", "left_semi").join(mosaic, ["request_id", "row", "col"], "left"), "mosaic")
    # others within the days around the date, where the mosaic is sparse
    sparse = base.groupBy("request_id").agg((F.count("v") / F.count("*")).alias("share")).where(F.col("share") < LEAST).select("request_id")
    other = of_best.join(sparse, "request_id", "left_semi").where((F.col("_apart") <= DAYS) & (F.col("item_id") != F.col("_best")))
    place = F.array_position("_named", F.col("provider"))
    fill = _page(other, F.when(place > 0, place), TILES).join(cells, "request_id").join(sound, ["item_id", "row", "col"])
    fill = fill.groupBy("request_id", "index_name", "row", "col").agg(*(F.median(b).alias(b) for b in bands))
    fill = fill.where(whole).select("request_id", "row", "col", value.cast("double").alias("_fill"))
    out = base.join(fill, ["request_id", "row", "col"], "left").join(asked.select("request_id", "index_name", "radar"), "request_id")
    v = F.coalesce("v", "_fill")
    clear = F.col("radar") | F.col("scl").isNull() | ~F.col("scl").isin(*lookups.CLOUDS_INDEX)
    values = out.select("request_id", "index_name", "row", "col", F.when(clear, v).alias("v"), (F.col("v").isNull() & F.col("_fill").isNotNull()).alias("filled"))
    found = all_.join(picks.select("request_id", F.lit(200).alias("_found")), "request_id", "left")
    status = found.select("request_id", F.coalesce("status", "_found", F.lit(404)).alias("status"), F.coalesce("detail", F.when(F.col("_found").isNull(), "No suitable item found for date/AOI")).alias("detail"))
    return Answers(status, picks, values)


def legend_bins(values: DataFrame, indices: Sequence[str]) -> DataFrame:
    """(request_id, index_name, bin, n, filled, mean): the bins of each request's legend that occur."""
    bin_ = _of_index({n: legend.index_bin(F.col("v"), n) for n in indices}).cast("int")
    return values.groupBy("request_id", "index_name", bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if("filled").alias("filled"), F.avg("v").alias("mean"))
