"""Rates, intervals, scores and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
INTERVAL_Z = 1.65
SAFETY_BANDS = [(70.0, "high"), (40.0, "medium")]
TREND_EPS = 1e-6


def bool_flag(value: Column) -> Column:
    """1 when true; false and null are 0."""
    return F.when(value, 1).otherwise(0)


def percentage(part: Column, total: Column) -> Column:
    """0..100, and 0 for an empty group."""
    return F.when(total > 0, part.cast("double") / total * 100.0).otherwise(0.0)


def fraction(part: Column, total: Column) -> Column:
    """0..1, and 0 when the total is zero or null."""
    return F.when(total > 0, part / total).otherwise(0.0)


def poisson_low(predicted: Column, z: float = INTERVAL_Z) -> Column:
    """B37 lower end. A negative prediction is treated as 0 so that the root exists."""
    p = F.greatest(predicted, F.lit(0.0))
    return F.when(predicted.isNotNull(), F.round(F.greatest(F.lit(0.0), p - F.lit(z) * F.sqrt(p)), 1))


def poisson_high(predicted: Column, z: float = INTERVAL_Z) -> Column:
    """B37 upper end."""
    p = F.greatest(predicted, F.lit(0.0))
    return F.when(predicted.isNotNull(), F.round(p + F.lit(z) * F.sqrt(p), 1))


def safety_score(predicted: Column, scale: Column) -> Column:
    """100 is safest; ``scale`` is the batch's 99th percentile, 1.0 when that is not positive."""
    usable = F.when(scale > 0, scale).otherwise(1.0)
    load = F.least(F.coalesce(predicted, F.lit(0.0)) / usable, F.lit(1.0))
    return F.round(F.lit(100.0) * (F.lit(1.0) - load), 2)


def safety_band(score: Column) -> Column:
    """High from 70, medium from 40, else low; 'no_data' when missing."""
    (high, high_label), (mid, mid_label) = SAFETY_BANDS
    return (F.when(score.isNull(), "no_data").when(score >= high, high_label)
            .when(score >= mid, mid_label).otherwise("low"))


def ranked_labels(cols: Sequence[str]) -> Column:
    """Array of (label, rank) with the missing and empty labels left out."""
    items = F.array(*[F.struct(F.col(c).alias("label"), F.lit(i + 1).alias("rank")) for i, c in enumerate(cols)])
    return F.filter(items, lambda x: x["label"].isNotNull() & (x["label"] != ""))


def trend_direction(delta: Column, eps: float = TREND_EPS) -> Column:
    """Up, down or flat."""
    return F.when(delta > eps, "up").when(delta < -eps, "down").otherwise("flat")


def fill_zero(cols: Sequence[str], type_: str = "int") -> dict[str, Column]:
    """Null to zero, with the target type."""
    return {c: F.coalesce(F.col(c), F.lit(0)).cast(type_) for c in cols}
