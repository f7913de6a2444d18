"""Gaps in reporting, and counters as per-interval deltas and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.series import SPAN, SeriesLayout, each_part, measure
from gaugeworks.schema import KEY, TIME


def with_previous(df: DataFrame, layout: SeriesLayout, columns: list[str]) -> DataFrame:
    """Add `_previous_<column>`: the value in the device's preceding sample, NULL in the first."""
    return each_part(df, layout, lambda rows, own: _with_previous(rows, own, columns))


def _with_previous(df: DataFrame, layout: SeriesLayout, columns: list[str]) -> DataFrame:
    """One part of the layout; the first sample of a span reads the last one of the span before it."""
    grouped = layout.attach(df.where(F.col(layout.key).isNotNull()))
    order = layout.ordered()
    result = grouped.select(
        "*", *[F.lag(c).over(order).alias(f"_previous_{c}") for c in columns]
    )
    if not layout.is_cut:
        return result
    ends = grouped.groupBy(*layout.group).agg(
        F.max_by(F.struct(*columns), layout.time).alias("_end")
    )
    earlier = Window.partitionBy(layout.key).orderBy(SPAN)
    ends = ends.select(*layout.group, F.lag("_end").over(earlier).alias("_end"))
    first = F.row_number().over(order) == 1
    kept = [c for c in grouped.columns if c != SPAN]
    return (
        result.withColumn("_first", first)
        .join(ends, layout.group)
        .select(
            *kept,
            *[
                F.when(F.col("_first"), F.col("_end")[c])
                .otherwise(F.col(f"_previous_{c}"))
                .alias(f"_previous_{c}")
                for c in columns
            ],
        )
    )


def _elapsed(time: str) -> Column:
    """Seconds since the preceding sample, fraction included."""
    return (F.col(time) - F.col(f"_previous_{time}")).cast("interval second").cast("decimal(18,6)").cast("double")


def flag_gaps(
    df: DataFrame, interval_seconds: float = 60.0, factor: float = 1.5, layout: SeriesLayout | None = None
) -> DataFrame:
    """Add `gap_seconds` since the preceding sample and `is_gap` where it exceeds factor x interval."""
    layout = layout or measure(df)
    out = with_previous(df, layout, [TIME]).withColumn("gap_seconds", _elapsed(TIME))
    late = F.coalesce(F.col("gap_seconds") > factor * interval_seconds, F.lit(False))
    return out.select(*df.columns, "gap_seconds", late.alias("is_gap"))


def counter_deltas(
    df: DataFrame, counters: list[str], layout: SeriesLayout | None = None
) -> DataFrame:
    """Add `<counter>_delta` and `<counter>_rate` (per second).

    A counter that fell was reset, so its delta is its new value. The first sample has neither.
    """
    layout = layout or measure(df)
    before = with_previous(df, layout, [TIME, *counters])
    out = before
    for c in counters:
        rise = F.col(c) - F.col(f"_previous_{c}")
        delta = F.when(rise < 0, F.col(c)).otherwise(rise)
        out = out.withColumn(f"{c}_delta", delta).withColumn(
            f"{c}_rate", F.try_divide(F.col(f"{c}_delta"), _elapsed(TIME))
        )
    return out.select(
        *df.columns, *[f"{c}_{kind}" for c in counters for kind in ("delta", "rate")]
    )


def liveness(
    df: DataFrame, interval_seconds: float, allowed: int = 3, as_of=None, key: str = KEY
) -> DataFrame:
    """Last report per device, silence as of a time, and whether it exceeds `allowed` intervals.

    Without `as_of` the newest report of any device is used, as a scalar subquery.
    """
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(TIME).alias("last_seen"))
    now = F.lit(as_of).cast("timestamp_ntz") if as_of is not None else df.agg(F.max(TIME)).scalar()
    silence = (now - F.col("last_seen")).cast("interval second").cast("decimal(18,6)").cast("double")
    return last.withColumn("silent_seconds", silence).withColumn(
        "is_down", F.col("silent_seconds") > allowed * interval_seconds
    )


def per_interval(df: DataFrame, columns: list[str], layout: SeriesLayout | None = None) -> DataFrame:
    """`df` with running counters replaced by what they gained since the device's preceding sample.

    For exporters that report totals where the telemetry schema has counts per interval; the first sample of a device
    has none.
    """
    deltas = counter_deltas(df, columns, layout)
    return deltas.select(*[F.col(f"{c}_delta").alias(c) if c in columns else F.col(c) for c in df.columns])
