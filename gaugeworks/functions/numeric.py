"""Clipping, normalising and labelling expressions. NULL in, NULL out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.schema import BOUNDS, WORKLOAD_CLASSES, RiskTiers


def clip(value: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Limit to [low, high], either side optional. greatest/least skip NULLs, hence the guard."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def clip_to_bounds(metric: str) -> Column:
    low, high = BOUNDS[metric]
    return clip(F.col(metric), low, high)


def normalize(value: Column, low: float, high: float) -> Column:
    """Position of the value inside [low, high], limited to [0, 1]."""
    high = max(high, low + 1e-8)
    return clip((value - F.lit(float(low))) / F.lit(float(high - low)), 0.0, 1.0)


def rescale(value: Column, low: Column, high: Column) -> Column:
    """`normalize` against computed limits."""
    top = F.greatest(high, low + F.lit(1e-8))
    return clip((value - low) / (top - low), 0.0, 1.0)


def risk_tier(risk: Column, tiers: RiskTiers = RiskTiers()) -> Column:
    """low / medium / high; an unknown risk counts as high."""
    return F.when(risk < tiers.low, "low").when(risk < tiers.medium, "medium").otherwise("high")


def workload_label(mean_util: Column) -> Column:
    """0 idle (<5), 1 light (<30), 2 steady (<70), 3 bursty; unknown utilisation is 0."""
    return (
        F.when(mean_util >= 70, 3).when(mean_util >= 30, 2).when(mean_util >= 5, 1).otherwise(0)
    ).cast("int")


def workload_name(label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in WORKLOAD_CLASSES]), label + 1)


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, blind to noise past the ninth digit."""
    return F.round(value.cast("decimal(30,9)"), digits).cast("double")
