"""What the scores are for: placement, draining, idle cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.functions.numeric import clip, round_to
from gaugeworks.schema import KEY

# Cost of a device's hour, utilisation below which it is idle, risk from which it is drained.
HOURLY_COST_USD = 2.50
IDLE_UTIL = 5.0
DRAIN_RISK = 0.66


def schedule_score(latest: DataFrame) -> DataFrame:
    """Add `schedule_score`: healthy, low-risk, little used devices with short queues score high.

    The longest queue is one value over all devices, read as a scalar subquery.
    """
    longest = latest.agg(F.max("queue_length_mean")).scalar()
    util = clip(F.col("gpu_util_mean"), 0.0, 100.0)
    queue = clip(F.col("queue_length_mean"), 0.0, None)
    # The weights.
    score = (
        0.4 * (F.col("gpu_health_score") / 100)
        + 0.3 * (1 - F.col("failure_risk_score"))
        + 0.2 * (1 - util / 100)
        + 0.1 * (1 - queue / F.greatest(longest, F.lit(1.0)))
    )
    return latest.withColumn("schedule_score", score)


def recommend_scheduling(latest: DataFrame, top_k: int = 5) -> DataFrame:
    """The best `top_k` devices for the next job, best first; equal scores by device id."""
    best = (
        schedule_score(latest)
        .orderBy(F.col("schedule_score").desc_nulls_last(), KEY)
        .limit(top_k)
    )
    reason = text.placement_reason(
        F.col("gpu_health_score"), F.col("failure_risk_score"), F.col("gpu_util_mean")
    )
    return best.select(
        KEY, round_to(F.col("schedule_score"), 4).alias("schedule_score"), reason.alias("reason")
    )


def devices_to_drain(latest: DataFrame, risk_threshold: float = DRAIN_RISK) -> DataFrame:
    return latest.where(F.col("failure_risk_score") >= risk_threshold).select(KEY)


def idle_devices(latest: DataFrame, idle_threshold: float = IDLE_UTIL) -> DataFrame:
    return latest.where(F.col("gpu_util_mean") < idle_threshold)


def cost_summary(
    latest: DataFrame,
    hourly_cost_usd: float = HOURLY_COST_USD,
    idle_threshold: float = IDLE_UTIL,
    window_hours: float = 1.0,
) -> DataFrame:
    """One row: idle and total devices, idle share, savings per window."""
    counts = latest.agg(
        F.count_if(F.col("gpu_util_mean") < idle_threshold).alias("num_idle_gpus"),
        F.count(F.lit(1)).alias("total_gpus"),
    )
    idle, total = F.col("num_idle_gpus"), F.greatest(F.col("total_gpus"), F.lit(1))
    return counts.select(
        "num_idle_gpus",
        "total_gpus",
        round_to(idle / total, 4).alias("idle_fraction"),
        round_to(idle * hourly_cost_usd * window_hours, 2).alias("estimated_savings_usd_per_window"),
        F.lit(float(window_hours)).alias("window_hours"),
    )


def idle_recommendations(
    latest: DataFrame, hourly_cost_usd: float = HOURLY_COST_USD, idle_threshold: float = IDLE_UTIL
) -> DataFrame:
    """One row per idle device with the suggestion and what it saves per hour."""
    saving: Column = round_to(F.lit(float(hourly_cost_usd)), 2)
    return idle_devices(latest, idle_threshold).select(
        KEY,
        round_to(F.col("gpu_util_mean"), 2).alias("gpu_util_mean"),
        F.lit(text.IDLE_SUGGESTION).alias("suggestion"),
        saving.alias("estimated_hourly_savings_usd"),
    )


def find_device(latest: DataFrame, device: str) -> DataFrame:
    """The device's row; an unknown device gives no row."""
    return latest.where(F.col(KEY) == device)
