import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import cleaned, frame, random_rows, rows_of
from gaugeworks.operators import cleaning, features, windows
from gaugeworks.operators.series import LENGTH, POSITION, SeriesLayout, index_series, measure
from gaugeworks.operators.cleaning import clean_samples
from gaugeworks.schema import METRICS, STAT_COLUMNS, WINDOW_END, WindowSpec

PLAIN = SeriesLayout()


def indexed(spark, rows, layout=PLAIN):
    return index_series(cleaning.group_samples(frame(spark, rows), layout), layout)


def brute(table, size, stride):
    """{(device, index): (end, values)} from cleaned pandas rows."""
    out = {}
    for device, group in table.groupby("gpu_id"):
        x = group[list(METRICS)].to_numpy(dtype="float64")
        for index, first in enumerate(range(0, len(x) - size + 1, stride)):
            out[device, index] = (group["timestamp"].iloc[first + size - 1], x[first : first + size])
    return out


@pytest.mark.parametrize("n, expected", [(29, 0), (30, 1), (34, 1), (35, 2), (39, 2), (40, 3)])
def test_window_count_at_the_edges(spark, n, expected):
    found = windows.window_table(indexed(spark, rows_of("a", [1.0] * n)), PLAIN)
    assert found.count() == expected


def test_only_the_last_window_is_latest(spark):
    rows = rows_of("a", [float(i % 90) for i in range(52)])
    found = windows.window_table(indexed(spark, rows), PLAIN).orderBy("window_index").collect()
    assert [r["is_latest"] for r in found] == [False] * 4 + [True]
    assert found[-1][WINDOW_END] == rows[49]["timestamp"]
    assert found[-1]["gpu_util_mean"] == pytest.approx(np.mean([i for i in range(20, 50)]))


@pytest.mark.parametrize("size, stride", [(30, 5), (7, 3), (4, 6)])
@pytest.mark.parametrize("cut", [False, True])
def test_windows_equal_brute_force(spark, size, stride, cut):
    rows = random_rows(5, {"hot": 170, "a": 41, "b": 6})
    df = frame(spark, rows)
    layout = measure(df, long_rows=45 if cut else 10**9, span_rows=20)
    spec = WindowSpec(size, stride)
    samples = clean_samples(df, layout)
    plain = {m: F.col(m) for m in METRICS}
    found = samples.each(
        lambda rows, own: windows.window_table(rows, own, spec, vector_of=plain, block_rows=25)
    ).collect()
    expected = brute(cleaned(rows, 5.0), size, stride)
    assert {(r["gpu_id"], r["window_index"]) for r in found} == set(expected)
    assert len(found) == len(expected)
    for r in found:
        end, x = expected[r["gpu_id"], r["window_index"]]
        assert r[WINDOW_END] == end
        np.testing.assert_allclose(r[windows.VECTOR], x.ravel(), rtol=1e-9)
        for name, value in (("mean", x.mean(axis=0)), ("std", x.std(axis=0)), ("max", x.max(axis=0))):
            mine = [r[f"{m}_{name}"] for m in METRICS]
            np.testing.assert_allclose(mine, value, rtol=1e-7, atol=1e-7)


def test_window_with_missing_value_has_missing_statistics(spark):
    rows = rows_of("a", [1.0, None, 3.0, 4.0, 5.0])
    found = windows.window_table(indexed(spark, rows), PLAIN, WindowSpec(2, 1)).orderBy("window_index").collect()
    assert [r["gpu_util_mean"] for r in found] == [None, None, 3.5, 4.5]
    assert [r["gpu_util_max"] for r in found] == [None, None, 4.0, 5.0]
    assert [r["gpu_temp_mean"] for r in found] == [30.0] * 4


def test_latest_per_device(spark):
    rows = rows_of("a", [1.0] * 40) + rows_of("b", [2.0] * 31, seq_from=100)
    found = windows.window_table(indexed(spark, rows), PLAIN)
    latest = windows.latest_per_device(found).collect()
    assert {r["gpu_id"]: r["window_index"] for r in latest} == {"a": 2, "b": 0}
    assert all(r["is_latest"] for r in latest)


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("lookback, horizon", [(12, 6), (3, 9)])
def test_sequences_equal_brute_force(spark, cut, lookback, horizon):
    rows = random_rows(8, {"hot": 130, "a": 18, "b": 17, "c": 4})
    df = frame(spark, rows)
    layout = measure(df, long_rows=45 if cut else 10**9, span_rows=20)
    samples = clean_samples(df, layout)
    targets = {m: F.col(m) for m in ("gpu_util", "mem_util")}
    inputs = {m: F.col(m) for m in METRICS}
    found = samples.each(
        lambda rows, own: windows.supervised_sequences(rows, own, inputs, targets, lookback, horizon, 25)
    ).collect()
    step = max(1, lookback // 2)
    expected = {}
    for device, group in cleaned(rows, 5.0).groupby("gpu_id"):
        x = group[list(METRICS)].to_numpy(dtype="float64")
        for index, first in enumerate(range(0, len(x) - lookback - horizon + 1, step)):
            middle = first + lookback
            expected[device, index] = (x[first:middle].ravel(), x[middle : middle + horizon, :2].ravel())
    assert {(r["gpu_id"], r["sequence_index"]) for r in found} == set(expected)
    for r in found:
        x, y = expected[r["gpu_id"], r["sequence_index"]]
        np.testing.assert_allclose(r["x"], x, rtol=1e-9)
        np.testing.assert_allclose(r["y"], y, rtol=1e-9)


def test_memberships_add_up_to_all_window_elements(spark):
    lengths = {"a": 29, "b": 30, "c": 47, "d": 100}
    rows = [r for i, (d, n) in enumerate(lengths.items()) for r in rows_of(d, [1.0] * n, seq_from=1000 * i)]
    for spec in (WindowSpec(), WindowSpec(7, 3), WindowSpec(4, 6)):
        samples = indexed(spark, rows)
        weight = features.window_memberships(F.col(POSITION), F.col(LENGTH), spec)
        total = samples.agg(F.sum(weight)).first()[0]
        count = sum(max(0, (n - spec.size) // spec.stride + 1) for n in lengths.values() if n >= spec.size)
        assert total == count * spec.size


def test_scaler_fit_equals_all_window_elements(spark):
    rows = random_rows(6, {"a": 80, "b": 45})
    df = frame(spark, rows)
    samples = clean_samples(df, PLAIN)
    scaler = features.fit_scaler(samples.each(windows.window_table))
    stacked = np.vstack([x for _, x in brute(cleaned(rows, 5.0), 30, 5).values()])
    np.testing.assert_allclose([scaler.mean[m] for m in METRICS], stacked.mean(axis=0), rtol=1e-9)
    np.testing.assert_allclose([scaler.std[m] for m in METRICS], stacked.std(axis=0), rtol=1e-9)


def test_one_exchange_from_raw_to_windows(spark, telemetry):
    table = clean_samples(telemetry, PLAIN).each(windows.window_table)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "node_id" not in plan.split("Exchange")[0]


def test_no_exchange_after_settling(spark, telemetry):
    samples = clean_samples(telemetry, PLAIN).settled()
    plan = samples.each(windows.window_table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_rejects_empty_windows():
    with pytest.raises(ValueError):
        WindowSpec(0, 5)
    with pytest.raises(ValueError):
        WindowSpec(5, 0)


def test_statistics_columns(spark):
    found = windows.window_table(indexed(spark, rows_of("a", [1.0] * 30)), PLAIN)
    assert set(STAT_COLUMNS) <= set(found.columns)
