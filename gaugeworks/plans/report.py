"""Result and dashboard documents of a scored fleet."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions import text
from gaugeworks.functions.numeric import risk_tier, round_to
from gaugeworks.operators.scoring import device_results, explain_failure_risk
from gaugeworks.operators.services import (
    DRAIN_RISK,
    HOURLY_COST_USD,
    IDLE_UTIL,
    cost_summary,
    devices_to_drain,
    find_device,
    idle_recommendations,
    recommend_scheduling,
)
from gaugeworks.operators.store import settle
from gaugeworks.plans.fingerprint import FOREST, Models, build_fingerprint
from gaugeworks.schema import KEY, RiskTiers

# Dashboard panel fields and the result fields they show.
PANEL_FIELDS = {
    "gpu_id": "gpu_id",
    "timestamp": "as_of",
    "health_score": "gpu_health_score",
    "failure_risk": "failure_risk_score",
    "risk_tier": "risk_tier",
    "eta_to_failure_steps": "estimated_time_to_failure_steps",
    "anomaly_score": "anomaly_score",
    "utilization_pct": "gpu_util_mean",
    "max_temp_c": "gpu_temp_max",
}


@dataclass(frozen=True)
class FleetReport:
    """Tables of one run, and the parameters their figures depend on."""

    fingerprint: DataFrame
    devices: DataFrame
    cluster: DataFrame
    scheduling: DataFrame
    drain: DataFrame
    cost: DataFrame
    idle: DataFrame
    tiers: RiskTiers = RiskTiers()
    hourly_cost_usd: float = HOURLY_COST_USD


def cluster_summary(latest: DataFrame) -> DataFrame:
    """One row: status, rounded mean health, number of devices."""
    found = latest.agg(F.avg("gpu_health_score").alias("h"), F.count(F.lit(1)).alias("n"))
    return found.select(
        F.when(F.col("n") > 0, "ok").otherwise("insufficient_data").alias("status"),
        round_to(F.col("h"), 2).alias("cluster_health_score"),
        F.col("n").alias("num_gpus"),
    )


def report(
    latest: DataFrame, hourly_cost_usd: float = HOURLY_COST_USD, tiers: RiskTiers = RiskTiers()
) -> FleetReport:
    """All tables derived from the latest window per device. `latest` should be settled."""
    return FleetReport(
        latest,
        device_results(latest, tiers),
        cluster_summary(latest),
        recommend_scheduling(latest),
        devices_to_drain(latest),
        cost_summary(latest, hourly_cost_usd),
        idle_recommendations(latest, hourly_cost_usd),
        tiers,
        hourly_cost_usd,
    )


def run(
    raw: DataFrame,
    models: Models,
    method: str = FOREST,
    hourly_cost_usd: float = HOURLY_COST_USD,
    **options,
) -> FleetReport:
    """Raw telemetry to all result tables; the fingerprint is computed once and settled."""
    latest = settle(build_fingerprint(raw, models, method, **options))
    return report(latest, hourly_cost_usd)


def _section(name: str, df: DataFrame, key: Column | str | None = None) -> DataFrame:
    """Rows (section, key, json) of a table; `key` orders them within the section."""
    own = F.lit("") if key is None else F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(name).alias("section"), own.alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))


def _ranked(best: DataFrame) -> DataFrame:
    """Placement sections: rows of a top-k list, keyed by their rank."""
    place = F.row_number().over(Window.orderBy(F.desc("schedule_score"), KEY))
    return best.withColumn("place", F.lpad(place.cast("string"), 6, "0"))


def _advice(tables: FleetReport, prefix: str, scheduling: str, drain: str) -> list[DataFrame]:
    ranked = _ranked(tables.scheduling)
    best = ranked.select(F.lit(scheduling).alias("section"), F.col("place").alias("key"), F.to_json(F.struct(*tables.scheduling.columns)).alias("json"))
    known = tables.cluster.select("status").scalar() == "ok"
    return [
        best,
        _section(drain, tables.drain, KEY),
        _section(f"{prefix}cost_optimization", tables.cost.where(known)),
        _section(f"{prefix}cost_optimization.recommendations", tables.idle, KEY),
    ]


def document(tables: FleetReport) -> DataFrame:
    """The result document as rows (section, key, json): lists have a row for every entry, ordered by key.

    No row or task holds the fleet, so it works for any number of devices.
    """
    known = F.when(F.col("status") == "ok", F.col("num_gpus")).alias("num_gpus")
    parts = [
        _section("result", tables.cluster.select("status", "cluster_health_score", known)),
        _section("gpus", tables.devices, KEY),
        *_advice(tables, "", "scheduling_recommendations", "gpus_recommended_for_drain"),
    ]
    return reduce(DataFrame.unionByName, parts)


def panels(devices: DataFrame) -> DataFrame:
    return devices.select(*[F.col(source).alias(name) for name, source in PANEL_FIELDS.items()])


def alerts(devices: DataFrame) -> DataFrame:
    """One row per device of medium or high tier. Texts show the rounded values."""
    severity = F.when(F.col("risk_tier") == "high", "critical").otherwise("warning")
    message = text.alert_message(
        F.col(KEY),
        F.col("risk_tier"),
        F.col("failure_risk_score"),
        F.col("estimated_time_to_failure_steps"),
    )
    raised = devices.where(F.col("risk_tier") != "low")
    return raised.select(severity.alias("severity"), KEY, message.alias("message"))


def dashboard_summary(tables: FleetReport) -> DataFrame:
    """The six figures on top of the dashboard, in one pass over the fingerprint; no row without devices."""
    risky = risk_tier(F.col("failure_risk_score"), tables.tiers) != "low"
    found = tables.fingerprint.agg(
        F.avg("gpu_health_score").alias("h"),
        F.count(F.lit(1)).alias("num_gpus"),
        F.count_if(risky).alias("num_alerts"),
        F.count_if(F.col("failure_risk_score") >= DRAIN_RISK).alias("num_gpus_recommended_for_drain"),
        F.count_if(F.col("gpu_util_mean") < IDLE_UTIL).alias("idle"),
    )
    return found.where("num_gpus > 0").select(
        round_to(F.col("h"), 2).alias("cluster_health_score"),
        "num_gpus",
        "num_alerts",
        "num_gpus_recommended_for_drain",
        round_to(F.col("idle") * tables.hourly_cost_usd, 2).alias("estimated_idle_savings_usd_per_window"),
        round_to(F.col("idle") / F.col("num_gpus"), 4).alias("idle_gpu_fraction"),
    )


def dashboard(tables: FleetReport, generated_at: str | None = None) -> DataFrame:
    """The dashboard document as rows (section, key, json); without devices its lists have no rows."""
    now = F.lit(generated_at) if generated_at else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    )
    parts = [
        _section("dashboard", tables.cluster.select(now.alias("generated_at"), "status")),
        _section("cluster_summary", dashboard_summary(tables)),
        _section("gpu_panels", panels(tables.devices), KEY),
        _section("alerts", alerts(tables.devices), KEY),
        *_advice(tables, "recommendations.", "recommendations.scheduling", "recommendations.drain_candidates"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_tables(tables: FleetReport, path: str, mode: str = "error") -> None:
    """Every table of the report as Parquet, without nesting anything."""
    for name in ("fingerprint", "devices", "cluster", "scheduling", "drain", "cost", "idle"):
        getattr(tables, name).write.mode(mode).parquet(f"{path}/{name}")
    panels(tables.devices).write.mode(mode).parquet(f"{path}/panels")
    alerts(tables.devices).write.mode(mode).parquet(f"{path}/alerts")


def explain_device(fingerprints: DataFrame, device: str) -> DataFrame:
    """Risk breakdown of one device from a stored fingerprint table."""
    return explain_failure_risk(find_device(fingerprints, device))
