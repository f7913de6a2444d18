from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import SCHEMA, START, frame, rows_of
from gaugeworks.operators import cleaning, counters, windows
from gaugeworks.operators.series import SeriesLayout, index_series, measure
from gaugeworks.schema import STAT_COLUMNS, WINDOW_END, WindowSpec
from gaugeworks.streaming import cleaned
from gaugeworks.streaming import liveness as live
from gaugeworks.streaming import windows as streamed

PLAIN = SeriesLayout()


def stream_of(spark, tmp_path, batches):
    """A stream that delivers one batch of rows per trigger."""
    source = str(tmp_path / "source")
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{source}/batch={i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")


def drain(spark, stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


def series(n=64):
    rng = np.random.default_rng(3)
    return rows_of("a", [float(v) for v in rng.uniform(0, 100, n)]) + rows_of(
        "b", [float(v) for v in rng.uniform(0, 100, n)], seq_from=1000
    )


def late(device="z", days=2):
    """A sample that moves the watermark past all others."""
    return rows_of(device, [1.0], start=START + timedelta(days=days), seq_from=99_000 + days)


@pytest.mark.parametrize("order", ["in order", "shuffled", "one late"])
def test_row_windows_on_a_stream_equal_the_batch_windows(spark, tmp_path, order):
    rows = series()
    rows.sort(key=lambda r: r["timestamp"])
    if order == "shuffled":  # by less than the lateness of ten minutes, across micro-batches
        rng = np.random.default_rng(5)
        rows = [rows[i] for i in np.argsort(np.arange(len(rows)) / 2 + rng.uniform(0, 8, len(rows)))]
    if order == "one late":
        rows = rows[:40] + rows[41:52] + rows[40:41] + rows[52:]
    batches = [rows[:50], rows[50:51] + rows[40:45], rows[51:90], rows[90:], late(), late(days=3)]
    stream = stream_of(spark, tmp_path, batches)
    name = f"row_windows_{order.replace(' ', '_')}"
    found = drain(spark, streamed.row_windows(stream, WindowSpec(10, 3)), tmp_path, name).toPandas()
    samples = index_series(cleaning.group_samples(frame(spark, rows), PLAIN), PLAIN)
    expected = windows.window_table(samples, PLAIN, WindowSpec(10, 3)).toPandas()
    found, expected = (f.sort_values(["gpu_id", "window_index"]).reset_index(drop=True) for f in (found, expected))
    assert list(found["window_index"]) == list(expected["window_index"])
    assert list(found[WINDOW_END]) == list(expected[WINDOW_END])
    np.testing.assert_allclose(
        found[list(STAT_COLUMNS)].astype(float), expected[list(STAT_COLUMNS)].astype(float), rtol=1e-7, atol=1e-7
    )


def test_a_sample_one_micro_batch_late_is_in_its_window(spark, tmp_path):
    rows = rows_of("a", [float(i) for i in range(12)])
    stream = stream_of(spark, tmp_path, [rows[:6], rows[7:9], rows[6:7] + rows[9:], late(), late(days=3)])
    found = drain(spark, streamed.row_windows(stream, WindowSpec(3, 3)), tmp_path, "one_late")
    means = [r["gpu_util_mean"] for r in found.where("gpu_id = 'a'").orderBy("window_index").collect()]
    assert means == [1.0, 4.0, 7.0, 10.0]


def test_idle_devices_leave_no_state(spark, tmp_path):
    rows = rows_of("a", [1.0] * 5)
    again = rows_of("a", [2.0] * 5, start=START + timedelta(days=40), seq_from=500)
    stream = stream_of(spark, tmp_path, [rows, late(days=20), late(days=30), late(days=35), again, late(days=60), late(days=70)])
    found = drain(spark, streamed.row_windows(stream, WindowSpec(3, 1), idle="1 day"), tmp_path, "idle")
    indexes = [r["window_index"] for r in found.where("gpu_id = 'a'").orderBy(WINDOW_END).collect()]
    assert indexes == [0, 1, 2, 0, 1, 2]  # the series began anew


def test_scores_on_a_stream_equal_the_batch_fingerprint(spark, tmp_path):
    from gaugeworks.plans import fingerprint

    rows = series(40)
    raw = frame(spark, rows)
    models = fingerprint.fit_models(raw, WindowSpec(10, 5), method=fingerprint.DEVIATION)
    limits = (0.0, 2.0)
    batch = fingerprint.build_fingerprint(raw, models, fingerprint.DEVIATION, limits=limits).orderBy("gpu_id").collect()
    rows.sort(key=lambda r: r["timestamp"])
    stream = stream_of(spark, tmp_path, [rows[:30], rows[30:], late(), late(days=3)])
    found = drain(spark, streamed.scored_windows(stream, models.scaler, limits), tmp_path, "scored")
    newest = {r["gpu_id"]: r for r in found.orderBy("window_index").collect()}
    for row in batch:
        for column in ("anomaly_score", "failure_risk_score", "gpu_health_score", "estimated_time_to_failure_steps"):
            assert newest[row["gpu_id"]][column] == pytest.approx(row[column])
        assert newest[row["gpu_id"]][WINDOW_END] == row[WINDOW_END]


def test_time_windows_on_a_stream_equal_row_windows_of_even_series(spark, tmp_path):
    rows = series(50)
    later = rows_of("a", [1.0], start=START + timedelta(days=1), seq_from=9000)
    stream = stream_of(spark, tmp_path, [rows, later, later])
    found = drain(spark, streamed.time_windows(stream, "10 minutes", "5 minutes"), tmp_path, "time_windows")
    full = found.where("n_samples = 10").toPandas().sort_values(["gpu_id", "window_start"])
    samples = index_series(cleaning.group_samples(frame(spark, rows), PLAIN), PLAIN)
    expected = windows.window_table(samples, PLAIN, WindowSpec(10, 5)).toPandas()
    expected = expected.sort_values(["gpu_id", "window_index"])
    assert len(full) == len(expected) == 18
    np.testing.assert_allclose(
        full[list(STAT_COLUMNS)].to_numpy(), expected[list(STAT_COLUMNS)].to_numpy(), rtol=1e-7, atol=1e-7
    )


def test_silent_devices_on_a_stream(spark, tmp_path):
    def at(device, minutes):
        return rows_of(device, [1.0], start=START + timedelta(minutes=minutes))

    batches = [at("a", 0) + at("b", 0), at("b", 30), at("b", 60), at("a", 61) + at("b", 61), at("b", 62)]
    stream = stream_of(spark, tmp_path, batches)
    watched = live.watch(stream, interval_seconds=300, allowed=3, lateness="1 minute")
    found = drain(spark, watched, tmp_path, "silent").collect()
    times = [(r["gpu_id"], r["last_seen"], r["is_down"]) for r in found if r["gpu_id"] == "a"]
    assert (times[0][1], times[0][2]) == (START, True)
    assert times[1][1:] == (START + timedelta(minutes=61), False)


@pytest.mark.parametrize("cut", [False, True])
def test_gaps_and_counters(spark, cut):
    rows = rows_of("a", [5.0, 7.0, 2.0, None, 9.0] * 8, step_seconds=[60, 60, 600, 60, 0.5] * 8)
    rows += rows_of("b", [1.0], seq_from=900)
    df = frame(spark, rows)
    layout = measure(df, long_rows=10, span_rows=4) if cut else PLAIN
    assert layout.is_cut == cut
    found = counters.flag_gaps(df, layout=layout).where("gpu_id = 'a'").orderBy("timestamp").collect()
    assert [r["gap_seconds"] for r in found] == [None, *([60, 60, 600, 60, 0.5] * 8)[:39]]
    assert [r["is_gap"] for r in found] == [g is not None and g > 90 for g in (r["gap_seconds"] for r in found)]
    deltas = counters.counter_deltas(df, ["gpu_util"], layout).orderBy("gpu_id", "timestamp").collect()
    assert [r["gpu_util_delta"] for r in deltas[:6]] == [None, 2.0, 2.0, None, None, 5.0]
    assert deltas[1]["gpu_util_rate"] == pytest.approx(2 / 60)
    assert deltas[-1]["gpu_util_delta"] is None


def test_batch_liveness(spark):
    df = frame(spark, rows_of("a", [1.0] * 3) + rows_of("b", [1.0], seq_from=9))
    found = {r["gpu_id"]: (r["silent_seconds"], r["is_down"]) for r in counters.liveness(df, 30, 3).collect()}
    assert found == {"a": (0.0, False), "b": (120.0, True)}
    later = counters.liveness(df, 60, 3, as_of=str(START + timedelta(minutes=6)))
    assert later.agg(F.count_if("is_down")).first()[0] == 2


@pytest.fixture
def state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    cleaned.use_state_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def rough_rows(devices="abc", n=70, seed=11):
    """Even series with gaps (also at both ends), several copies, spikes beyond five deviations and values out of bounds."""
    pick, out, seq = np.random.default_rng(seed), [], 0
    for device in devices:
        for row in rows_of(device, [float(v) for v in pick.normal(50, 8, n)]):
            at = int((row["timestamp"] - START).total_seconds()) // 60
            row["power_watts"] = float(pick.normal(300, 2)) if at != 40 else 690.0
            row["cpu_util"] = float(pick.normal(60, 30))
            for m in ("gpu_util", "power_watts", "net_throughput_mbps"):
                if at != 40 and pick.random() < 0.3 or (at < 4 and m == "gpu_util") or (at > n - 5 and m == "power_watts"):
                    row[m] = None
            if device == "c":
                row["disk_io_mbps"] = None  # never reported
            for copy in range(1 + int(pick.random() < 0.2)):
                out.append(row | {"seq": seq, "gpu_temp": 40.0 + copy})
                seq += 1
    return out


def in_batches(rows, size, seed=2):
    """Shuffled by less than ten minutes, copies apart, dealt to micro-batches."""
    pick = np.random.default_rng(seed)
    minutes = np.array([(r["timestamp"] - START).total_seconds() / 60 for r in rows])
    order = np.argsort(minutes + pick.uniform(0, 8, len(rows)), kind="stable")
    return [[rows[i] for i in order[at : at + size]] for at in range(0, len(order), size)]


def test_clean_windows_on_a_stream_equal_the_batch_windows(state_store, tmp_path):
    spark, rows, spec = state_store, rough_rows(), WindowSpec(10, 5)
    raw = frame(spark, rows)
    batches = in_batches(rows, 90) + [late(days=2), late(days=20), late(days=30)]
    stream = stream_of(spark, tmp_path, batches)
    found = drain(spark, cleaned.clean_windows(stream, spec, cleaned.device_profile(raw), hold="5 days"), tmp_path, "clean_windows")
    found = found.where("gpu_id <> 'z'").toPandas()
    samples = cleaning.clean_samples(raw, PLAIN)
    expected = samples.each(lambda r, own: windows.window_table(r, own, spec)).toPandas()
    found, expected = (f.sort_values(["gpu_id", "window_index"]).reset_index(drop=True) for f in (found, expected))
    assert list(found["window_index"]) == list(expected["window_index"]) and len(found) == 3 * 13
    assert list(found[WINDOW_END]) == list(expected[WINDOW_END])
    np.testing.assert_allclose(
        found[list(STAT_COLUMNS)].astype(float), expected[list(STAT_COLUMNS)].astype(float), rtol=1e-7, atol=1e-7
    )
    plain = raw.where("gpu_id = 'a'").agg(F.max("power_watts")).first()[0]
    assert found.loc[found["gpu_id"] == "a", "power_watts_max"].max() < plain  # the spike was clipped


def test_streamed_scores_of_rough_series_equal_the_fingerprint(state_store, tmp_path):
    from gaugeworks.plans import fingerprint

    spark, rows = state_store, rough_rows(devices="ab", seed=4)
    raw = frame(spark, rows)
    models = fingerprint.fit_models(raw, WindowSpec(10, 5), method=fingerprint.DEVIATION)
    limits = (0.0, 2.0)
    batch = fingerprint.build_fingerprint(raw, models, fingerprint.DEVIATION, limits=limits).collect()
    stream = stream_of(spark, tmp_path, in_batches(rows, 70) + [late(days=9), late(days=20)])
    scored = cleaned.fingerprint_stream(stream, models.scaler, limits, cleaned.device_profile(raw), hold="2 days")
    found = drain(spark, scored, tmp_path, "clean_scores")
    newest = {r["gpu_id"]: r for r in found.orderBy("window_index").collect()}
    assert {r["gpu_id"] for r in batch} == {"a", "b"}
    for row in batch:
        for column in ("anomaly_score", "failure_risk_score", "gpu_health_score", "estimated_time_to_failure_steps"):
            assert newest[row["gpu_id"]][column] == pytest.approx(row[column])
        assert newest[row["gpu_id"]][WINDOW_END] == row[WINDOW_END]


def test_held_gaps_are_closed_and_idle_series_begin_anew(state_store, tmp_path):
    spark = state_store
    rows = rows_of("a", [1.0, 2.0, 3.0, None, None, None])
    again = rows_of("a", [7.0] * 3, start=START + timedelta(days=40), seq_from=500)
    batches = [rows, late(days=1), late(days=2), late(days=20), again, late(days=60), late(days=70)]
    stream = stream_of(spark, tmp_path, batches)
    found = drain(spark, cleaned.clean_windows(stream, WindowSpec(3, 1), hold="6 hours"), tmp_path, "held")
    got = [(r["window_index"], r["gpu_util_mean"]) for r in found.where("gpu_id = 'a'").orderBy(WINDOW_END).collect()]
    assert [i for i, _ in got] == [0, 1, 2, 3, 0]
    assert [m for _, m in got] == pytest.approx([2.0, 8 / 3, 3.0, 3.0, 7.0])


def test_known_devices_are_watched_from_the_start(state_store, tmp_path):
    spark = state_store

    def at(device, minutes):
        return rows_of(device, [1.0], start=START + timedelta(minutes=minutes))

    known = spark.createDataFrame(
        [("old", START, False), ("down", START - timedelta(days=1), True), ("gone", START - timedelta(days=90), True), ("b", START, False)],
        "gpu_id string, last_seen timestamp_ntz, is_down boolean",
    )
    batches = [at("b", 10), at("b", 30), at("b", 60), at("down", 61) + at("gone", 62) + at("b", 62), at("b", 63), at("b", 200), at("b", 201)]
    stream = stream_of(spark, tmp_path, batches)
    watched = live.watch_known(stream, known, interval_seconds=300, allowed=3, lateness="1 minute", forget="30 days")
    found = [(r["gpu_id"], r["last_seen"], r["is_down"]) for r in drain(spark, watched, tmp_path, "known").collect()]
    assert ("old", START, True) in found  # silent since before the stream began
    assert ("down", START + timedelta(minutes=61), False) in found  # came back
    assert not [r for r in found if r[0] == "gone" and not r[2]]  # had vanished, so it is new
    changes = [r[2] for r in found if r[0] == "b"]
    assert changes == [True, False] * (len(changes) // 2) + [True] * (len(changes) % 2)


def test_vanished_devices_leave_no_state(state_store, tmp_path):
    spark = state_store
    stream = stream_of(spark, tmp_path, [rows_of("a", [1.0]), late(days=1), late(days=9), late(days=10)])
    drain(spark, live.watch_known(stream, interval_seconds=60, forget="3 days"), tmp_path, "vanished")
    kept = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "vanished"))
    assert {r["key"]["gpu_id"] for r in kept.collect()} == {"z"}
