"""Failure risk, health and time to failure, and their exact breakdown per device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.functions.numeric import clip, normalize, risk_tier, round_to
from gaugeworks.schema import KEY, WINDOW_END, RiskTiers, RiskWeights

# The contributions in the order that settles ties for the top driver.
DRIVERS = ("anomaly", "ecc_xid_errors", "thermal", "utilization_instability")
# Steps to failure of a healthy device, and the risk up to which it counts as healthy.
HEALTHY_STEPS = 500
HEALTHY_RISK = 0.05

SCORE_COLUMNS = (
    "gpu_health_score",
    "failure_risk_score",
    "estimated_time_to_failure_steps",
    "anomaly_score",
)


def risk_terms(
    weights: RiskWeights, anomaly: Column, ecc: Column, xid: Column, temp: Column, util_std: Column
) -> dict[str, Column]:
    """Weighted terms of the failure risk, keyed by driver. A missing input makes its term NULL."""
    # The ranges.
    errors = normalize(ecc, 0, 10), normalize(xid, 0, 5)
    worst = F.when(errors[0].isNotNull() & errors[1].isNotNull(), F.greatest(*errors))
    return {
        "anomaly": weights.anomaly * anomaly,
        "ecc_xid_errors": weights.ecc_xid * worst,
        "thermal": weights.thermal * normalize(temp, 70, 100),
        "utilization_instability": weights.utilization_stability * normalize(util_std, 0, 40),
    }


INPUTS = ("anomaly_score", "ecc_errors_max", "xid_errors_max", "gpu_temp_max", "gpu_util_std")


def health_score(stats: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Add risk, health and steps to failure to window statistics that carry `anomaly_score`."""
    terms = risk_terms(weights, *[F.col(c) for c in INPUTS])
    scored = stats.withColumn("failure_risk_score", clip(sum(terms.values()), 0.0, 1.0))
    risk = F.col("failure_risk_score")
    return scored.withColumn("gpu_health_score", (1 - risk) * 100.0).withColumn(
        "estimated_time_to_failure_steps",
        F.when(risk > HEALTHY_RISK, clip((1 - risk) * HEALTHY_STEPS, 1, HEALTHY_STEPS)).otherwise(
            F.lit(float(HEALTHY_STEPS))
        ),
    )


def cluster_health(latest: DataFrame) -> DataFrame:
    return latest.agg(F.avg("gpu_health_score").alias("cluster_health_score"))


def explain_failure_risk(latest: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Per device: the four contributions (four digits each), their sum, the largest one, a sentence.

    Columns that are absent or NULL count as 0.
    """
    present = set(latest.columns)
    values = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in present else F.lit(0.0) for c in INPUTS
    ]
    terms = risk_terms(weights, *values)
    shares = latest.select(
        KEY, *[round_to(term, 4).alias(f"contribution_{name}") for name, term in terms.items()]
    )
    parts = {name: F.col(f"contribution_{name}") for name in DRIVERS}
    largest = F.greatest(*parts.values())
    driver = F.coalesce(*[F.when(part == largest, F.lit(name)) for name, part in parts.items()])
    total = round_to(sum(parts.values()), 4)
    return shares.select(
        KEY,
        total.alias("failure_risk_score"),
        *[c for c in shares.columns if c != KEY],
        driver.alias("top_driver"),
        text.explanation(total, driver, largest).alias("explanation"),
    )


def device_results(latest: DataFrame, tiers: RiskTiers = RiskTiers()) -> DataFrame:
    """The nine reported fields per device, rounded for display."""
    digits = {
        "gpu_health_score": 2,
        "failure_risk_score": 4,
        "risk_tier": None,
        "estimated_time_to_failure_steps": 1,
        "anomaly_score": 4,
        "gpu_util_mean": 2,
        "gpu_temp_max": 2,
    }
    tiered = latest.withColumn("risk_tier", risk_tier(F.col("failure_risk_score"), tiers))
    return tiered.select(
        KEY,
        text.timestamp_text(F.col(WINDOW_END)).alias("as_of"),
        *[c if d is None else round_to(F.col(c), d).alias(c) for c, d in digits.items()],
    )
