import json

import pytest
from pyspark.sql import functions as F

from fixtures import frame, random_rows
from gaugeworks.plans import fingerprint, report
from gaugeworks.schema import STAT_COLUMNS


@pytest.fixture(scope="module")
def fleet(spark):
    return frame(spark, random_rows(9, {d: 70 for d in "abcd"}, missing=0.05)).cache()


@pytest.fixture(scope="module")
def tables(spark, fleet):
    models = fingerprint.fit_models(fleet, trees=10)
    return report.run(fleet, models, hourly_cost_usd=3.0)


def sections(df):
    """Section -> its entries in order of key."""
    out = {}
    for row in sorted(df.collect(), key=lambda r: (r["section"], r["key"])):
        out.setdefault(row["section"], []).append(json.loads(row["json"]))
    return out


def parsed(df):
    """A result document nested again."""
    found = sections(df)
    doc = found["result"][0] | {"gpus": found.get("gpus", [])}
    if doc["status"] == "ok":
        doc["scheduling_recommendations"] = found.get("scheduling_recommendations", [])
        doc["gpus_recommended_for_drain"] = [x["gpu_id"] for x in found.get("gpus_recommended_for_drain", [])]
        doc["cost_optimization"] = found["cost_optimization"][0] | {"recommendations": found.get("cost_optimization.recommendations", [])}
    return doc


def test_result_document(tables):
    doc = parsed(report.document(tables))
    assert doc["status"] == "ok" and doc["num_gpus"] == 4
    assert [g["gpu_id"] for g in doc["gpus"]] == list("abcd")
    assert set(doc["gpus"][0]) == {
        "gpu_id", "as_of", "gpu_health_score", "failure_risk_score", "risk_tier",
        "estimated_time_to_failure_steps", "anomaly_score", "gpu_util_mean", "gpu_temp_max",
    }
    scores = [r["schedule_score"] for r in doc["scheduling_recommendations"]]
    assert scores == sorted(scores, reverse=True) and len(scores) == 4
    mean = sum(g["gpu_health_score"] for g in doc["gpus"]) / 4
    assert doc["cluster_health_score"] == pytest.approx(mean, abs=0.01)
    assert doc["gpus_recommended_for_drain"] == [
        g["gpu_id"] for g in doc["gpus"] if g["failure_risk_score"] >= 0.66
    ]
    assert doc["cost_optimization"]["total_gpus"] == 4
    assert doc["cost_optimization"]["recommendations"] == []


def test_dashboard_agrees_with_the_result(tables):
    doc, board = parsed(report.document(tables)), sections(report.dashboard(tables, "2024-01-01T00:00:00+00:00"))
    assert board["dashboard"] == [{"generated_at": "2024-01-01T00:00:00+00:00", "status": "ok"}]
    assert [p["failure_risk"] for p in board["gpu_panels"]] == [g["failure_risk_score"] for g in doc["gpus"]]
    raised = [g["gpu_id"] for g in doc["gpus"] if g["risk_tier"] != "low"]
    assert [a["gpu_id"] for a in board.get("alerts", [])] == raised
    assert board["cluster_summary"][0]["num_alerts"] == len(raised)
    assert board["cluster_summary"][0]["num_gpus"] == 4
    assert board["recommendations.scheduling"] == doc["scheduling_recommendations"]
    assert [x["gpu_id"] for x in board.get("recommendations.drain_candidates", [])] == doc["gpus_recommended_for_drain"]
    now = sections(report.dashboard(tables))["dashboard"][0]["generated_at"]
    assert now.endswith("+00:00") and "T" in now


def test_explanation_of_one_device(tables):
    row = report.explain_device(tables.fingerprint, "b").first()
    exact = tables.fingerprint.where("gpu_id = 'b'").first()["failure_risk_score"]
    assert row["failure_risk_score"] == pytest.approx(exact, abs=2.5e-4)
    assert report.explain_device(tables.fingerprint, "nobody").count() == 0


def test_no_device_has_enough_history(spark, fleet):
    models = fingerprint.fit_models(fleet, method=fingerprint.DEVIATION)
    short = fleet.orderBy("timestamp").limit(10)
    tables = report.run(short, models, fingerprint.DEVIATION)
    assert parsed(report.document(tables)) == {"status": "insufficient_data", "gpus": []}
    board = sections(report.dashboard(tables))
    assert board["dashboard"][0]["status"] == "insufficient_data"
    assert set(board) == {"dashboard"}


def test_fleets_are_written_as_tables(spark, tables, tmp_path):
    report.write_tables(tables, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "fingerprint"))
    assert stored.count() == 4 and set(STAT_COLUMNS) <= set(stored.columns)
    assert spark.read.parquet(str(tmp_path / "out" / "panels")).count() == 4
