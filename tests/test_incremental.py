"""Runs day by day against one run over everything, and sketches that merge against exact answers."""

from datetime import timedelta
from functools import partial
from uuid import uuid4

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import START, frame, rows_of
from gaugeworks.operators import anomaly, cleaning, limits, moments, windows
from gaugeworks.operators.series import SeriesLayout, measure
from gaugeworks.operators.store import own_folder
from gaugeworks.plans import fingerprint, incremental
from gaugeworks.schema import KEY, METRICS, STAT_COLUMNS, WINDOW_END, WindowSpec
from gaugeworks.streaming.cleaned import device_profile, profile_of
from test_streaming import rough_rows

SPEC = WindowSpec(10, 5)


def new_folder(spark):
    return f"{own_folder(spark)}/{uuid4().hex}"


def minutes(row):
    return (row["timestamp"] - START).total_seconds() / 60


def sliced(rows, cuts):
    return [[r for r in rows if a <= minutes(r) < b] for a, b in zip([-1, *cuts], [*cuts, 10**9], strict=True)]


def settled(spark, df):
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def batch_windows(raw):
    samples = cleaning.clean_samples(raw, SeriesLayout())
    return samples.each(lambda r, own: windows.window_table(r, own, SPEC)).toPandas()


def assert_same(found, expected):
    found, expected = (f.sort_values([KEY, WINDOW_END]).reset_index(drop=True) for f in (found, expected))
    assert list(found["window_index"]) == list(expected["window_index"]) and len(found)
    assert list(found[WINDOW_END]) == list(expected[WINDOW_END])
    np.testing.assert_allclose(found[list(STAT_COLUMNS)].astype(float), expected[list(STAT_COLUMNS)].astype(float), rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("cut", [False, True])
def test_runs_by_slices_equal_one_run(spark, monkeypatch, cut):
    """Gaps across runs, copies, spikes, a metric that is never reported, devices that appear, pause and end."""
    if cut:
        monkeypatch.setattr(incremental, "measure", partial(measure, long_rows=12, span_rows=5))
    rows = rough_rows() + rows_of("d", [1.0, None, 3.0], start=START + timedelta(minutes=33), seq_from=9000)
    rows += rows_of("e", [5.0] * 4, seq_from=9500) + rows_of("e", [None] * 9, start=START + timedelta(minutes=50), seq_from=9600)
    raw = frame(spark, rows)
    profile = settled(spark, device_profile(raw))
    state, parts = incremental.empty_state(spark), []
    slices = sliced(rows, [17, 34, 35, 52])
    for i, own in enumerate(slices):
        step = incremental.advance(state, frame(spark, own), SPEC, profile=profile, finish=i == len(slices) - 1)
        parts.append(step.windows().toPandas())
        state = settled(spark, step.state)
        assert state.groupBy(KEY).count().agg(F.max("count")).first()[0] is not None
    assert_same(pd.concat(parts), batch_windows(raw))


def test_a_run_reads_only_the_open_rows_and_the_new_samples(spark):
    rows = rough_rows(devices="ab")
    first, second = sliced(rows, [40])
    folder = new_folder(spark)
    frame(spark, first).write.parquet(f"{folder}/old")
    frame(spark, second).write.parquet(f"{folder}/new")
    state = settled(spark, incremental.advance(incremental.empty_state(spark), spark.read.parquet(f"{folder}/old"), SPEC).state)
    assert state.count() < 80  # the open rows of two devices, not their series
    step = incremental.advance(state, spark.read.parquet(f"{folder}/new"), SPEC)
    for frame_ in (step.windows(), step.state):
        assert not [f for f in frame_.inputFiles() if "/old/" in f]


def test_held_samples_close_and_late_ones_are_dropped(spark):
    rows = rows_of("a", [1.0, 2.0, 3.0] + [None] * 6)
    step = incremental.advance(incremental.empty_state(spark), frame(spark, rows), WindowSpec(3, 3), until=START + timedelta(hours=2), hold=timedelta(hours=1))
    assert [round(r["gpu_util_mean"], 6) for r in step.windows().orderBy(WINDOW_END).collect()] == [2.0, 3.0, 3.0]
    state = settled(spark, step.state)
    late = rows_of("a", [99.0], start=START + timedelta(minutes=4), seq_from=50)
    more = rows_of("a", [6.0] * 3, start=START + timedelta(hours=3), seq_from=60)
    again = incremental.advance(state, frame(spark, late + more), WindowSpec(3, 3))
    assert [round(r["gpu_util_mean"], 6) for r in again.windows().collect()] == [6.0]
    waits = incremental.advance(incremental.empty_state(spark), frame(spark, rows), WindowSpec(3, 3))
    assert waits.windows().count() == 1
    with pytest.raises(ValueError):
        incremental.advance(state, frame(spark, more), WindowSpec(1, 1))


def test_stored_runs_and_the_current_fingerprint(spark, tmp_path):
    rows = rough_rows(devices="ab", seed=8)
    raw = frame(spark, rows)
    models = fingerprint.fit_models(raw, SPEC, method=fingerprint.DEVIATION)
    profile = settled(spark, device_profile(raw))
    path = str(tmp_path / "runs")
    with pytest.raises(ValueError):
        incremental.current_fingerprint(spark, path, (0.0, 1.0))
    slices = sliced(rows, [20, 45])
    for i, own in enumerate(slices):
        new = frame(spark, own)
        if i == 1:  # a run that was killed before its state was written is done again
            incremental.run_day(spark, path, new, f"2024-01-0{i + 1}", models.scaler, profile=profile)
            marker = tmp_path / "runs" / "state" / f"run={i}" / "_SUCCESS"
            marker.unlink()
        incremental.run_day(spark, path, new, f"2024-01-0{i + 1}", models.scaler, profile=profile, finish=i == 2)
    assert incremental.versions(spark, f"{path}/state") == [0, 1, 2]
    found = {r[KEY]: r for r in incremental.current_fingerprint(spark, path, (0.0, 2.0)).collect()}
    batch = fingerprint.build_fingerprint(raw, models, fingerprint.DEVIATION, limits=(0.0, 2.0)).collect()
    assert set(found) == {"a", "b"}
    for row in batch:
        assert found[row[KEY]][WINDOW_END] == row[WINDOW_END]
        for column in ("anomaly_score", "failure_risk_score", "gpu_health_score"):
            assert found[row[KEY]][column] == pytest.approx(row[column])
    refit, _ = fingerprint.linear_models(moments.moments_of(moments.stored_moments(spark, f"{path}/moments")), SPEC)
    for m in METRICS:
        assert refit.mean[m] == pytest.approx(models.scaler.mean[m], rel=1e-9)
        assert refit.std[m] == pytest.approx(models.scaler.std[m], rel=1e-9, abs=1e-12)
    stored = spark.read.parquet(f"{path}/windows")
    low, high = limits.merged_limits(limits.stored_sketches(spark, f"{path}/limits"), [0.0, 1.0])
    assert [low, high] == pytest.approx(list(anomaly.min_max(stored, "raw_anomaly")))


def test_merged_limits_are_within_their_rank_error(spark, tmp_path):
    pick = np.random.default_rng(1)
    days = [pick.gamma(2.0, 1.0, 30_000), pick.gamma(2.0, 5.0, 40_000), np.full(10_000, 3.0)]
    path = str(tmp_path / "limits")
    for i, own in enumerate(days):
        df = spark.createDataFrame([(float(v),) for v in own[:50]] + [(None,), (float("nan"),)], "v double")
        df = df.unionByName(spark.createDataFrame([(own[50:].tolist(),)], "vs array<double>").select(F.explode("vs").alias("v")))
        limits.store_sketch(df, "v", path, f"2024-01-0{i + 1}")
    for first, last, own in ((None, None, days), ("2024-01-02", None, days[1:]), (None, "2024-01-01", days[:1])):
        values = np.sort(np.concatenate(own))
        sketches = limits.stored_sketches(spark, path, first, last)
        assert sketches.agg(F.sum("n")).first()[0] == len(values)
        for share, found in zip((0.01, 0.5, 0.99), limits.merged_limits(sketches, [0.01, 0.5, 0.99]), strict=True):
            low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
            assert low - 0.01 <= share <= high + 0.01
    with pytest.raises(ValueError):
        limits.merged_limits(limits.stored_sketches(spark, path, "2030-01-01"), [0.5])


def test_devices_of_spans_are_compared(spark):
    df = spark.range(60_000).selectExpr("concat('d', id % 40000) AS gpu_id", "CASE WHEN id < 30000 THEN 'a' ELSE 'b' END AS span")
    # a: 0..29999; b: 30000..39999 and 0..19999
    found = {r["span"]: r for r in limits.device_sketches(df, "gpu_id", F.col("span")).collect()}
    assert set(found) == {"a", "b"}
    both = limits.device_sketches(df, "gpu_id", F.col("span")).groupBy().pivot("span", ["a", "b"]).agg(F.first("devices"))
    row = both.select(*limits.compared_devices(F.col("a"), F.col("b"))).first()
    for column, exact in (("n_both", 20_000), ("n_new", 10_000), ("n_lost", 10_000), ("n_any", 40_000)):
        assert abs(row[column] - exact) < 0.04 * 40_000
    small = df.where("id < 50 OR id >= 59990")
    row = limits.device_sketches(small, "gpu_id", F.col("span")).groupBy().pivot("span", ["a", "b"]).agg(F.first("devices"))
    assert tuple(row.select(*limits.compared_devices(F.col("a"), F.col("b"))).first()) == (0, 10, 50, 60)  # exact while few
    whole = limits.merged_devices(limits.device_sketches(df, "gpu_id", F.col("span")))
    assert abs(whole.select(F.expr("theta_sketch_estimate(devices)")).first()[0] - 40_000) < 1600


def test_a_run_settles_its_samples_by_device(spark):
    """Windows and vectors of a run read them without a shuffle; buckets go with the rows."""
    raw = frame(spark, rough_rows(devices="ab"))
    step = incremental.advance(incremental.empty_state(spark), raw, SPEC, profile=settled(spark, device_profile(raw)), finish=True)
    for found in (step.windows(), step.windows(False, {m: F.col(m) for m in METRICS})):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    layout = measure(raw)
    assert layout.rows == raw.where(F.col(KEY).isNotNull()).count()
    assert layout.in_buckets(8).tasks == 8 and SeriesLayout(rows=36_000_000).in_buckets(8).tasks == 72


def test_scaler_and_profile_from_samples_cleaned_once(spark):
    raw = frame(spark, rough_rows())
    bounded = cleaning.bounded_samples(raw, measure(raw).in_buckets(3)).settled()
    once = bounded.clipped().each(lambda r, own: windows.window_table(r, own, SPEC)).toPandas()
    assert_same(once, batch_windows(raw))
    found, expected = (df.toPandas().sort_values(KEY) for df in (profile_of(bounded), device_profile(raw)))
    for column in ("mean", "std"):
        np.testing.assert_allclose(np.array(found[column].to_list(), float), np.array(expected[column].to_list(), float), rtol=1e-12, atol=1e-12)


def test_open_rows_are_no_copies(spark):
    """Open rows without a time, or from runs that did not know the order of copies, keep their place."""
    first = frame(spark, rows_of("a", [1.0, 2.0, 3.0])).drop("seq").withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))
    state = settled(spark, incremental.advance(incremental.empty_state(spark), first, SPEC).state)
    again = incremental.advance(state, frame(spark, rows_of("a", [4.0, 5.0], seq_from=50)), SPEC, finish=True)
    assert sorted(r["_position"] for r in again.state.collect()) == [0, 1, 2, 3, 4]
