"""Exact percentiles without a task of all values: brackets from a sketch, counts below them, and only what lies in a bracket is gathered.

Of one series as numbers, of all groups of a table as a table."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved

#: Accuracy of the sketch, and distinct values of all brackets that are gathered at once.
ACCURACY, GATHERED = 10_000, 50_000


def exact_percentiles(values: DataFrame, v: str, fractions: Sequence[float]) -> list[float]:
    """The percentiles of v, by linear interpolation between neighbours; nulls and NaN don't count. Empty without values.

    Each round is a pass that narrows the brackets of the ranks that are asked for to about a five-thousandth; values in brackets are gathered once few are
    distinct. Equal values count as one, however many they are.
    """
    data = values.select(F.col(v).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = data.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return []
    at = [f * (n - 1) for f in fractions]
    ranks = sorted({k for a in at for k in (math.floor(a), math.ceil(a))})
    brackets = {k: (low, high) for k in ranks}
    found: dict[int, float] = {}
    while brackets:
        ends = sorted(set(brackets.values()))
        inside = lambda e: (F.col("v") >= e[0]) & (F.col("v") <= e[1])
        counts = data.agg(*(c for i, e in enumerate(ends) for c in (F.count_if(F.col("v") < e[0]).alias(f"b{i}"), F.count_if(inside(e)).alias(f"n{i}"), F.approx_count_distinct(F.when(inside(e), F.col("v"))).alias(f"d{i}")))).first()
        below, held = {e: counts[f"b{i}"] for i, e in enumerate(ends)}, {e: counts[f"n{i}"] for i, e in enumerate(ends)}
        few = [e for i, e in enumerate(ends) if counts[f"d{i}"] <= GATHERED // len(ends) or e[0] == e[1]]
        if few:
            wanted = _any([inside(e) for e in few])
            rows = sorted(map(tuple, data.where(wanted).groupBy("v").agg(F.count("*").alias("n")).collect()))
            for k in [k for k, e in brackets.items() if e in few]:
                e, seen = brackets.pop(k), 0
                for value, m in rows:
                    if e[0] <= value <= e[1]:
                        seen += m
                        if below[e] + seen > k:
                            found[k] = value
                            break
        if brackets:
            asked: dict[tuple[float, float], list[tuple[int, float, float]]] = {}
            for k, e in brackets.items():
                asked.setdefault(e, []).append((k, max(0.0, (k - below[e]) / held[e] - 2 / ACCURACY), min(1.0, (k - below[e] + 1) / held[e] + 2 / ACCURACY)))
            # ranks in one bracket share its sketch
            sketches = [F.percentile_approx(F.when(inside(e), F.col("v")), F.array(*(F.lit(x) for _, a, b in of for x in (a, b))), F.lit(ACCURACY)) for e, of in asked.items()]
            got = data.agg(*(s.alias(f"p{i}") for i, s in enumerate(sketches))).first()
            brackets = {k: (got[i][2 * j], got[i][2 * j + 1]) for i, of in enumerate(asked.values()) for j, (k, *_) in enumerate(of)}
    return [found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) for a in at]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


#: Groups of at most SMALL values are sorted whole, each in a task. The values of larger ones lie in WAYS x WAYS parts between approximate percentiles.
WAYS, SMALL = 32, 65_536


def divided(values: DataFrame, keys: Sequence[str], v: str) -> tuple[DataFrame, DataFrame | None]:
    """(*keys, _v) of the groups of at most SMALL values, and of the larger ones, None if there are none; nulls and NaN don't count, and a null key names no group."""
    names = list(keys)
    sound = values.select(*names, F.col(v).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    for k in names:
        sound = sound.where(F.col(k).isNotNull())
    data = saved(sound, "series")
    large = saved(data.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > SMALL).select(*names), "large")
    if large.isEmpty():
        return data, None
    return data.join(large, names, "left_anti"), data.join(large, names, "left_semi")


def percentiles_of(v: np.ndarray, fractions: Sequence[float]) -> np.ndarray:
    """The percentiles of sorted values, by linear interpolation between neighbours."""
    at = np.array(fractions, dtype=float) * (len(v) - 1)
    low, high = v[np.floor(at).astype(int)], v[np.ceil(at).astype(int)]
    return low + (high - low) * (at - np.floor(at))


def of_small(data: DataFrame, keys: Sequence[str], run: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """(*keys, n, name): what run makes of the sorted values of each group, an array of doubles; data are the small groups of divided(). One shuffle."""
    names, kinds = list(keys), dict(data.dtypes)

    def group(table: pa.Table) -> pa.Table:
        v = np.sort(table.column("_v").to_numpy())
        out = table.slice(0, 1).select(names).append_column("n", pa.array([len(v)], pa.int64()))
        return out.append_column(name, pa.array([run(v)], pa.list_(pa.float64())))

    shape = ", ".join(f"`{k}` {kinds[k]}" for k in names)
    return data.groupBy(*names).applyInArrow(group, f"{shape}, n long, {name} array<double>")


def grouped_percentiles(values: DataFrame, keys: Sequence[str], v: str, fractions: Sequence[float]) -> DataFrame:
    """(*keys, n, percentiles): of every group the percentiles of v, an array in the order of fractions, by linear interpolation between neighbours; nulls and NaN don't count, and a group without values has no row.

    Small groups are sorted, each in a task; large ones go by sketched_percentiles().
    """
    small, large = divided(values, keys, v)
    out = of_small(small, keys, lambda x: percentiles_of(x, fractions), "percentiles")
    return out if large is None else out.unionByName(sketched_percentiles(large, keys, fractions))


def sketched_percentiles(data: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """grouped_percentiles() of the large groups of divided().

    One plan for all groups, whatever their number or size: a sketch of each group cuts it into parts; exact counts of the parts say which one each rank falls in; of
    those parts alone, equal values are counted and ranked. The sketch decides only how large a part is, never the result.
    """
    names = list(keys)
    cuts = F.array(*(F.lit(i / WAYS**2) for i in range(1, WAYS**2)))
    sketch = data.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_v", cuts, F.lit(ACCURACY)).alias("_s"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(WAYS - 1)), lambda i: F.element_at("_s", i * WAYS))
    fine = F.transform(F.sequence(F.lit(0), F.lit(WAYS - 1)), lambda i: F.slice("_s", i * WAYS + 1, WAYS - 1))
    sketch = saved(sketch.select(*names, "_n", coarse.alias("_coarse"), fine.alias("_fine")), "sketch")
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_v")))
    parts = data.join(sketch.drop("_n"), names).withColumn("_a", below("_coarse")).select(*names, "_v", (F.col("_a") * WAYS + below(F.get("_fine", F.col("_a")))).alias("_part"))
    counts = parts.groupBy(*names, "_part").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.array(*(F.lit(float(f)) * (F.col("_n") - 1) for f in fractions))
    ranks = F.array_distinct(F.concat(F.transform(at, lambda a: F.floor(a)), F.transform(at, lambda a: F.ceil(a))))
    asked = sketch.select(*names, "_n", F.explode(ranks).alias("_rank"))
    found = counts.withColumn("_before", before).join(asked, names).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
    found = saved(found.select(*names, "_n", "_part", "_rank", "_before"), "ranks")
    inside = parts.join(found.select(*names, "_part").distinct(), [*names, "_part"], "left_semi").groupBy(*names, "_part", "_v").agg(F.count("*").alias("_m"))
    less = F.coalesce(F.sum("_m").over(Window.partitionBy(*names, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = inside.withColumn("_less", less + 0).join(found, [*names, "_part"])
    met = met.where((F.col("_rank") - F.col("_before") >= F.col("_less")) & (F.col("_rank") - F.col("_before") < F.col("_less") + F.col("_m")))
    out = met.groupBy(*names, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))
    value = lambda rank: F.element_at("_values", rank)
    between = F.transform(at, lambda a: value(F.floor(a)) + (value(F.ceil(a)) - value(F.floor(a))) * (a - F.floor(a)))
    return out.select(*names, F.col("_n").alias("n"), between.alias("percentiles"))
