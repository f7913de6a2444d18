import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import numeric, text
from gaugeworks.operators import scoring, services
from gaugeworks.schema import WINDOW_END

FIELDS = (
    "gpu_id string, anomaly_score double, ecc_errors_max double, xid_errors_max double, gpu_temp_max double,"
    " gpu_util_std double, gpu_util_mean double, queue_length_mean double"
)


def stats(spark, *rows):
    return spark.createDataFrame(list(rows), FIELDS)


def one(spark, column, **inputs):
    values = ", ".join(
        f"CAST({'NULL' if v is None else v} AS double) AS {k}" for k, v in inputs.items()
    )
    return spark.sql(f"SELECT {values}").select(column).first()[0]


def test_normalize(spark):
    def norm(x, lo, hi):
        return one(spark, numeric.normalize(F.col("x"), lo, hi), x=x)

    assert norm(85, 70, 100) == 0.5
    assert norm(20, 70, 100) == 0 and norm(500, 70, 100) == 1
    assert norm(None, 70, 100) is None
    assert norm(3, 3, 3) == 0 and norm(4, 3, 3) == 1


@pytest.mark.parametrize(
    "risk, tier", [(0.0, "low"), (0.3299, "low"), (0.33, "medium"), (0.66, "high"), (1, "high"), (None, "high")]
)
def test_risk_tier(spark, risk, tier):
    assert one(spark, numeric.risk_tier(F.col("x")), x=risk) == tier


@pytest.mark.parametrize(
    "util, label", [(None, 0), (4.99, 0), (5, 1), (29.9, 1), (30, 2), (69.9, 2), (70, 3), (100, 3)]
)
def test_workload_label(spark, util, label):
    found = numeric.workload_label(F.col("x"))
    assert one(spark, found, x=util) == label
    assert one(spark, numeric.workload_name(found), x=util) == ("idle", "light", "steady", "bursty")[label]


def test_health_formula_and_its_limits(spark):
    df = stats(
        spark,
        ("a", 0.5, 2.0, 4.0, 85.0, 20.0, 50.0, 0.0),
        ("worst", 1.0, 99.0, 99.0, 200.0, 99.0, 50.0, 0.0),
        ("fine", 0.0, 0.0, 0.0, 40.0, 0.0, 50.0, 0.0),
        ("unknown", None, 0.0, 0.0, 40.0, 0.0, 50.0, 0.0),
    )
    found = {r["gpu_id"]: r for r in scoring.health_score(df).collect()}
    risk = 0.35 * 0.5 + 0.25 * 0.8 + 0.2 * 0.5 + 0.2 * 0.5
    assert found["a"]["failure_risk_score"] == pytest.approx(risk)
    assert found["a"]["gpu_health_score"] == pytest.approx((1 - risk) * 100)
    assert found["a"]["estimated_time_to_failure_steps"] == pytest.approx((1 - risk) * 500)
    assert found["worst"]["failure_risk_score"] == 1 and found["worst"]["estimated_time_to_failure_steps"] == 1
    assert found["fine"]["failure_risk_score"] == 0 and found["fine"]["estimated_time_to_failure_steps"] == 500
    assert found["unknown"]["failure_risk_score"] is None
    assert found["unknown"]["estimated_time_to_failure_steps"] == 500


def test_steps_jump_at_the_healthy_risk(spark):
    # Thermal term alone: (t - 70) / 30 * 0.2.
    df = stats(
        spark, ("at", 0.0, 0.0, 0.0, 77.5, 0.0, 0.0, 0.0), ("above", 0.0, 0.0, 0.0, 77.6, 0.0, 0.0, 0.0)
    )
    found = {r["gpu_id"]: r["estimated_time_to_failure_steps"] for r in scoring.health_score(df).collect()}
    assert found["at"] == 500
    assert found["above"] < 475


def test_explanation_ties_and_defaults(spark):
    df = stats(spark, ("a", 0.0, 0.0, 0.0, 100.0, 40.0, 0.0, 0.0))
    row = scoring.explain_failure_risk(df).first()
    assert row["top_driver"] == "thermal"  # equal to utilisation, but earlier in the fixed order
    assert row["failure_risk_score"] == 0.4
    assert row["explanation"] == (
        "Failure risk of 0.40 is primarily driven by 'thermal' (contributes 0.20 of the total score)."
    )
    bare = spark.createDataFrame([("b",)], "gpu_id string")
    row = scoring.explain_failure_risk(bare).first()
    assert row["failure_risk_score"] == 0 and row["top_driver"] == "anomaly"


def test_two_digits_round_like_exact_binary_values(spark):
    numbers = [i / 10_000 for i in range(10_001)] + [0.125, 0.375, 0.005, 0.015, 1.0]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    found = df.select("x", text.two_digits(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in found] == [f"{r['x']:.2f}" for r in found]


def test_alert_texts(spark):
    df = spark.createDataFrame(
        [("gpu-009", "high", 0.6811, 159.4), ("b", "medium", 0.4, 250.5), ("c", "low", 0.1, 500.0)],
        "g string, t string, r double, e double",
    )
    message = text.alert_message(F.col("g"), F.col("t"), F.col("r"), F.col("e"))
    found = [r[0] for r in df.select(message).collect()]
    assert found == [
        "gpu-009 has high failure risk (0.68); estimated 159 steps to failure.",
        "b shows elevated failure risk (0.40); monitor closely.",
        None,
    ]


def test_device_results_are_rounded(spark):
    df = spark.sql(
        "SELECT 'gpu-009' AS gpu_id, timestamp_ntz'2024-01-07 23:55:00' AS window_end_timestamp,"
        " 31.8878D AS gpu_health_score, 0.681122D AS failure_risk_score,"
        " 159.439D AS estimated_time_to_failure_steps, 0.99999D AS anomaly_score,"
        " 50.005D AS gpu_util_mean, 90D AS gpu_temp_max"
    )
    row = scoring.device_results(df).first()
    assert row["as_of"] == "2024-01-07 23:55:00"
    assert (row["gpu_health_score"], row["failure_risk_score"], row["risk_tier"]) == (31.89, 0.6811, "high")
    assert (row["estimated_time_to_failure_steps"], row["anomaly_score"]) == (159.4, 1.0)


def latest(spark, *rows):
    fields = "gpu_id string, gpu_health_score double, failure_risk_score double, gpu_util_mean double, queue_length_mean double"
    return spark.createDataFrame(list(rows), fields)


def test_scheduling_order_ties_and_reasons(spark):
    df = latest(
        spark,
        ("b", 90.0, 0.1, 10.0, 0.5),
        ("a", 90.0, 0.1, 10.0, 0.5),
        ("c", 50.0, 0.5, 90.0, 0.0),
        ("d", 10.0, 0.9, 150.0, -1.0),
    )
    found = services.recommend_scheduling(df, top_k=3).collect()
    assert [r["gpu_id"] for r in found] == ["a", "b", "c"]
    assert found[0]["reason"] == "high health score, low failure risk, currently underutilized"
    assert found[2]["reason"] == "best available option among current candidates"
    # The longest queue is below 1, so 1 is the divisor.
    expected = 0.4 * 0.9 + 0.3 * 0.9 + 0.2 * 0.9 + 0.1 * 0.5
    assert found[0]["schedule_score"] == pytest.approx(round(expected, 4))


def test_scheduling_is_a_top_k_without_a_cross_join(spark):
    df = latest(spark, ("a", 90.0, 0.1, 10.0, 0.5))
    plan = services.recommend_scheduling(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_drain_is_inclusive_and_idle_is_strict(spark):
    df = latest(spark, ("a", 34.0, 0.66, 5.0, 0.0), ("b", 35.0, 0.65, 4.99, 0.0), ("c", 1.0, None, None, 0.0))
    assert [r[0] for r in services.devices_to_drain(df).collect()] == ["a"]
    assert [r["gpu_id"] for r in services.idle_devices(df).collect()] == ["b"]
    cost = services.cost_summary(df, hourly_cost_usd=3.0, window_hours=2.0).first()
    assert cost.asDict() == {
        "num_idle_gpus": 1,
        "total_gpus": 3,
        "idle_fraction": 0.3333,
        "estimated_savings_usd_per_window": 6.0,
        "window_hours": 2.0,
    }


def test_costs_of_an_empty_fleet(spark):
    cost = services.cost_summary(latest(spark)).first()
    assert (cost["num_idle_gpus"], cost["total_gpus"], cost["idle_fraction"]) == (0, 0, 0.0)


def test_timestamp_text(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-02 03:04:05' AS a, timestamp_ntz'2024-01-02 03:04:05.000120' AS b"
    )
    row = df.select(text.timestamp_text(F.col("a")), text.timestamp_text(F.col("b"))).first()
    assert tuple(row) == ("2024-01-02 03:04:05", "2024-01-02 03:04:05.000120")


def test_health_stays_in_bounds_for_any_statistics(spark):
    rng = np.random.default_rng(0)
    rows = [("d", float(rng.random()), *[float(v) for v in rng.normal(50, 60, 6)]) for _ in range(200)]
    for r in scoring.health_score(stats(spark, *rows)).collect():
        assert 0 <= r["failure_risk_score"] <= 1 and 0 <= r["gpu_health_score"] <= 100
        assert 1 <= r["estimated_time_to_failure_steps"] <= 500
    assert WINDOW_END == "window_end_timestamp"
