"""Ladders from numbers to classes and scores, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups


def ladder(v: Column, steps: Sequence[tuple[float, object]], top: object, missing: object = None) -> Column:
    """The value of the first step that v is below, top above all; missing for null."""
    out = F.when(v.isNull(), F.lit(missing))
    for edge, value in steps:
        out = out.when(v < edge, F.lit(value))
    return out.otherwise(F.lit(top))


def vegetation_class(index: str, v: Column) -> Column:
    if index == "SUCROSE":
        return ladder(v, ((0.2, "Immature"), (0.4, "Early Maturity"), (0.6, "Optimal")), "Overmature", "No Data")
    return ladder(v, ((0.2, "Very Poor"), (0.4, "Moderate"), (0.6, "Good")), "Very Good", "No Data")


def water_class(index: str, v: Column) -> Column:
    if index == "MSI":
        return ladder(v, ((0.3, "Very Wet"), (0.5, "Wet"), (0.7, "Moderate"), (1.0, "Dry")), "Very Dry", "No Data")
    if index == "WI":
        return ladder(v, ((1.0, "Dry"), (1.5, "Moderate")), "Wet", "No Data")
    return ladder(v, ((0.1, "Very Low"), (0.2, "Low"), (0.3, "Moderate"), (0.4, "High")), "Very High", "No Data")


def bin_of(v: Column, edges: Sequence[float], max_bin: int) -> Column:
    """Bins open on the right: clipped to the edges first, so infinities have a bin; null and NaN: 0."""
    last = len(edges) - 1
    out = F.when(v.isNull() | F.isnan(v), 0)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(v < edge, min(k, max_bin))
    return out.otherwise(min(last, max_bin)).cast("int")


def factor(score: Column) -> Column:
    return ladder(score, ((35, 0.4), (50, 0.55), (65, 0.7), (80, 0.85)), 1.0, 0.7)


def health_status(health: Column) -> Column:
    return ladder(health, ((50, "Poor"), (75, "Moderate")), "Healthy")


def health_stress(health: Column) -> Column:
    return ladder(health, ((50, "High"), (75, "Medium")), "Low")


def growth_stage(days: Column) -> Column:
    """By days after sowing; unknown: vegetative."""
    return ladder(days, [(last + 1, name) for name, (last, _, _) in lookups.STAGES.items() if last], "maturity", "vegetative")


def stage_score(v: Column, lo: Column, hi: Column) -> Column:
    """0 to 100: the value on a scale from -1 to 1, ten more inside the stage's range, less outside by how far."""
    span = F.greatest(hi - lo, F.lit(1e-6))
    base = (v + 1) / 2 * 100
    shifted = F.when(v < lo, base - F.least(F.lit(40.0), (lo - v) / span * 35)).when(v > hi, base - F.least(F.lit(25.0), (v - hi) / span * 20)).otherwise(base + 10)
    return F.when(v.isNull() | F.isnan(v), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), shifted)))


def absolute_zone(v: Column, nutrient: str) -> Column:
    lo, hi = lookups.ABSOLUTE_THRESHOLDS[nutrient]
    return F.when(v.isNull(), 0).when(v < lo, 1).when(v <= hi, 2).otherwise(3)


def relative_zone(v: Column, inner: Column) -> Column:
    """1 and one more for each inner edge below v; null: 0. inner: an array without repeats."""
    return F.when(v.isNull(), 0).otherwise(1 + F.size(F.filter(inner, lambda e: e < v)))
