from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import START, cleaned, frame, random_rows, rows_of
from gaugeworks.operators import cleaning
from gaugeworks.operators.series import LENGTH, POSITION, SeriesLayout, index_series, measure
from gaugeworks.schema import METRICS, SEQ

PLAIN = SeriesLayout()


def values(df, metric="gpu_util", device="a"):
    rows = df.where(F.col("gpu_id") == device).orderBy("timestamp").collect()
    return [r[metric] for r in rows]


def fill(spark, rows):
    df = frame(spark, rows)
    return cleaning.fill_gaps(cleaning.group_samples(df, PLAIN), PLAIN, list(METRICS))


def test_gaps_inner_leading_trailing_and_all_missing(spark):
    rows = rows_of("a", [None, 2.0, None, None, 8.0, None]) + rows_of("b", [None, None], seq_from=50)
    out = fill(spark, rows)
    assert values(out) == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert values(out, device="b") == [None, None]


def test_gap_fill_goes_by_position_not_by_time(spark):
    out = fill(spark, rows_of("a", [0.0, None, 10.0], step_seconds=[60, 6000, 60]))
    assert values(out) == [0.0, 5.0, 10.0]


def test_last_copy_wins_and_rows_without_device_vanish(spark):
    rows = rows_of("a", [1.0]) + rows_of("a", [2.0], seq_from=5) + rows_of(None, [3.0], seq_from=9)
    assert values(cleaning.keep_last(frame(spark, rows))) == [2.0]
    out = cleaning.preprocess(frame(spark, rows))
    assert out.count() == 1
    assert values(out) == [2.0]


def test_empty_table(spark):
    out = cleaning.preprocess(frame(spark, []))
    assert out.count() == 0
    assert out.columns == frame(spark, []).columns


def test_bounds_keep_missing_values(spark):
    out = cleaning.clip_bounds(frame(spark, rows_of("a", [-5.0, 500.0, None, 40.0])))
    assert values(out) == [0.0, 100.0, None, 40.0]


@pytest.mark.parametrize("n, clipped", [(26, False), (40, True)])
def test_one_spike_needs_enough_samples_to_be_an_outlier(spark, n, clipped):
    rows = rows_of("a", [0.0] * (n - 1) + [10_000.0], metric="disk_io_mbps")
    out = cleaning.preprocess(frame(spark, rows))
    top = max(values(out, "disk_io_mbps"))
    assert (top < 10_000.0) == clipped
    mean, std = 10_000 / n, 10_000 * ((n - 1) ** 0.5) / n
    if clipped:
        assert top == pytest.approx(mean + 5 * std)


def test_constant_series_is_left_alone(spark):
    out = cleaning.preprocess(frame(spark, rows_of("a", [7.0] * 30)))
    assert values(out) == [7.0] * 30


LENGTHS = {"hot": 400, "a": 37, "b": 3, "c": 120}


@pytest.mark.parametrize("long_rows, span_rows", [(10**9, 1), (100, 10), (30, 50), (1, 1)])
def test_cleaning_equals_brute_force_for_any_cut(spark, long_rows, span_rows):
    rows = random_rows(3, LENGTHS)
    df = frame(spark, rows)
    layout = measure(df, long_rows=long_rows, span_rows=span_rows)
    assert layout.is_cut == (long_rows < 10**9)
    mine = cleaning.preprocess(df, z_threshold=2.5, layout=layout).toPandas()
    mine = mine.sort_values(["gpu_id", "timestamp"]).reset_index(drop=True)
    expected = cleaned(rows, 2.5)
    assert list(mine["gpu_id"]) == list(expected["gpu_id"])
    assert list(mine[SEQ]) == list(expected[SEQ])
    pd.testing.assert_frame_equal(mine[list(METRICS)], expected[list(METRICS)], rtol=1e-9)


def test_long_gap_across_several_spans(spark):
    rows = rows_of("a", [1.0] + [None] * 48 + [50.0])
    df = frame(spark, rows)
    layout = measure(df, long_rows=10, span_rows=5)
    assert values(cleaning.preprocess(df, layout=layout)) == pytest.approx([float(i) for i in range(1, 51)])


def test_positions_and_lengths_of_a_cut_series(spark):
    df = frame(spark, rows_of("a", [1.0] * 57) + rows_of("b", [1.0] * 4, seq_from=100))
    layout = measure(df, long_rows=20, span_rows=10)
    out = index_series(cleaning.group_samples(df, layout), layout).orderBy("gpu_id", "timestamp").collect()
    assert [r[POSITION] for r in out] == [*range(57), *range(4)]
    assert {r[LENGTH] for r in out if r["gpu_id"] == "a"} == {57}
    assert len({r["_span"] for r in out if r["gpu_id"] == "a"}) >= 5


def clocks():
    """Times that equal durations would not cut: even ones, one reset clock, a burst, copies, missing times."""
    even = [START + timedelta(seconds=i) for i in range(2000)]
    return {
        "even": even,
        "reset": [datetime(1970, 1, 1), *even[1:]],
        "burst": even[:20] + [even[20] + timedelta(microseconds=i) for i in range(1980)],
        "missing": even[:1999] + [None],
    }


@pytest.mark.parametrize("name", sorted(clocks()))
def test_spans_have_about_equal_numbers_of_rows(spark, name):
    rows = rows_of("a", [1.0] * 2000)
    for row, time in zip(rows, clocks()[name], strict=True):
        row["timestamp"] = time
    df = frame(spark, rows)
    layout = measure(df, long_rows=100, span_rows=250)
    spans = cleaning.group_samples(df, layout).groupBy("_span").count().collect()
    assert max(r["count"] for r in spans) <= 500


def test_short_spans_share_tasks_and_files(spark):
    """A span of its own for every task and file made the `_cut` queries take hours on millions of rows."""
    rows = rows_of("a", [1.0] * 700) + rows_of("b", [1.0] * 300, seq_from=1000)
    df = frame(spark, rows)
    layout = measure(df, long_rows=60, span_rows=20)
    dealt = layout.attach(df)
    assert len(dealt.inputFiles()) <= spark.sparkContext.defaultParallelism < layout.spans
    spans = dealt.groupBy("gpu_id", "_span").agg(F.count("*").alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    found = spans.orderBy("gpu_id", "_span").collect()
    assert len(found) >= layout.spans and max(r["n"] for r in found) <= 20
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:], strict=False) if a["gpu_id"] == b["gpu_id"])
    assert layout.ranges(12) == 12 and SeriesLayout(spans=300_000, span_rows=20).ranges(12) == 24


def test_equal_times_are_one_sample_in_the_cut_form(spark):
    rows = rows_of("a", [1.0] * 300, step_seconds=0)
    for row in rows[150:]:
        row["timestamp"] = None
    df = frame(spark, rows)
    layout = measure(df, long_rows=100, span_rows=50)
    assert layout.is_cut and cleaning.preprocess(df, layout=layout).count() == 2


@pytest.mark.parametrize("cut", [False, True])
def test_infinite_values_stay_and_do_not_spread(spark, cut):
    rows = rows_of("a", [float(i) for i in range(1, 9)])
    for row, value in zip(rows, [1, 2, 3, float("inf"), 5, 6, 7, 8], strict=True):
        row["ecc_errors"] = float(value)
    df = frame(spark, rows)
    layout = measure(df, long_rows=3, span_rows=2) if cut else PLAIN
    out = cleaning.preprocess(df, layout=layout).orderBy("timestamp").collect()
    assert [r["ecc_errors"] for r in out] == [1, 2, 3, float("inf"), 5, 6, 7, 8]


def test_missing_time_is_last_in_its_series(spark):
    rows = rows_of("a", [1.0, None, 3.0])
    rows[1]["timestamp"] = None
    df = frame(spark, rows * 1)
    for layout in (PLAIN, measure(df, long_rows=1, span_rows=1)):
        out = cleaning.preprocess(df, layout=layout).collect()
        assert {r["timestamp"]: r["gpu_util"] for r in out}[None] == 3.0


def test_counts(spark):
    rows = rows_of("a", [None, 1.0, None]) + rows_of("a", [5.0], seq_from=7)
    df = frame(spark, rows)
    assert cleaning.count_missing(df).collect()[0]["n_missing"] == 2
    assert cleaning.count_duplicates(df).first()[0] == 1
    assert cleaning.count_duplicates(frame(spark, [])).first()[0] == 0


def test_many_copies_of_one_sample_are_reduced_before_the_shuffle(spark):
    """A third of all rows are copies of one sample."""
    rows = rows_of("a", [float(i % 50) for i in range(60)])
    copies = [dict(rows[10], seq=1000 + i) for i in range(200)]
    df = frame(spark, rows + copies)
    layout = measure(df, long_rows=50, span_rows=20)
    plan = cleaning.keep_last(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    out = cleaning.preprocess(df, layout=layout)
    assert out.count() == 60
    assert out.where(F.col("timestamp") == F.lit(START + timedelta(seconds=600))).first()[SEQ] == 1199
