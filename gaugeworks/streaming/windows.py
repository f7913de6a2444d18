"""Window statistics on a stream of telemetry."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.functions.numeric import rescale
from gaugeworks.operators.cleaning import clip_bounds
from gaugeworks.operators.features import WindowScaler
from gaugeworks.operators.scoring import SCORE_COLUMNS, health_score
from gaugeworks.schema import KEY, METRICS, STAT_COLUMNS, TIME, WINDOW_END, RiskWeights, WindowSpec

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def event_time(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Watermarked stream without repeated samples. Watermarks need a zoned timestamp."""
    timed = stream.where(F.col(KEY).isNotNull()).withColumn(TIME, F.col(TIME).cast("timestamp"))
    return timed.withWatermark(TIME, lateness).dropDuplicatesWithinWatermark([KEY, TIME])


def time_windows(
    stream: DataFrame, size: str = "30 minutes", slide: str = "5 minutes", lateness: str = "10 minutes"
) -> DataFrame:
    """Statistics per device and sliding time window, built-in aggregates only.

    Equal to row-count windows where samples are evenly spaced, without gaps, and windows start with the
    series; partial windows at both ends are reported too, with fewer `n_samples`.
    """
    grouped = event_time(stream, lateness).groupBy(KEY, F.window(TIME, size, slide).alias("w"))
    stats = [
        F.expr(f"{function}({m}) AS {m}_{name}")
        for m in METRICS
        for name, function in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"))
    ]
    found = grouped.agg(F.count(F.lit(1)).alias("n_samples"), F.max(TIME).alias(WINDOW_END), *stats)
    return found.select(KEY, F.col("w.start").alias("window_start"), WINDOW_END, "n_samples", *STAT_COLUMNS)


OUTPUT = f"{KEY} string, {WINDOW_END} timestamp, window_index bigint, " + ", ".join(
    f"{c} double" for c in STAT_COLUMNS
)
STATE = "seen bigint, last bigint, tail array<double>, times array<bigint>, pending array<double>"


def row_windows(
    stream: DataFrame, spec: WindowSpec = WindowSpec(), lateness: str = "10 minutes", idle: str = "7 days"
) -> DataFrame:
    """Exact strided row-count windows over samples in any order within the lateness.

    A device's samples wait in its state until the watermark has passed them, since only then their order is known;
    a window comes out when its last sample has. The state is a row counter, the last size-1 samples and those that
    wait. It goes after `idle` of event time without samples; a device that returns later starts anew. Samples older
    than the watermark are dropped by Spark. One micro-batch of one device must fit into a Python task.
    """
    size, stride, width = spec.size, spec.stride, len(METRICS)
    metrics = list(METRICS)
    keep_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        seen, last, tail, times, pending = state.get if state.exists else (0, None, [], [], [])
        times = np.array(times, dtype="int64")
        values = np.array(pending, dtype="float64").reshape(-1, width)
        timed_out = state.hasTimedOut
        if not timed_out:
            parts = [(b[TIME].astype("datetime64[us]").astype("int64").to_numpy(), b[metrics].to_numpy(dtype="float64")) for b in batches]
            times = np.concatenate([times, *[t for t, _ in parts]])
            values = np.vstack([values, *[v for _, v in parts]])
            order = np.argsort(times, kind="stable")
            times, values = times[order], values[order]
        elif not len(times):
            state.remove()
            return
        mark = state.getCurrentWatermarkMs()
        ready = int(np.searchsorted(times, mark * 1000, "right"))
        if ready:
            before = np.array(tail, dtype="float64").reshape(-1, width)
            known = np.vstack([before, values[:ready]])
            first = seen - len(before)  # series position of known[0]
            ends = np.arange(seen, seen + ready)
            ends = ends[(ends >= size - 1) & ((ends - (size - 1)) % stride == 0)]
            if len(ends):
                cut = known[ends[:, None] - first + np.arange(1 - size, 1)[None, :]]
                stats = np.stack([cut.mean(axis=1), cut.std(axis=1), cut.max(axis=1)], axis=2)
                out = pd.DataFrame(stats.reshape(len(ends), -1), columns=list(STAT_COLUMNS))
                out = out.where(out.notna(), None)
                out.insert(0, "window_index", (ends - (size - 1)) // stride)
                out.insert(0, WINDOW_END, pd.to_datetime(times[ends - seen], unit="us"))
                out.insert(0, KEY, key[0])
                yield out
            seen, last = seen + ready, int(times[ready - 1])
            tail = known[max(0, len(known) - (size - 1)) :].ravel().tolist() if size > 1 else []
        times, values = times[ready:], values[ready:]
        state.update((seen, last, tail, times.tolist(), values.ravel().tolist()))
        due = int(times[0]) // 1000 + 1 if len(times) else last // 1000 + keep_ms
        state.setTimeoutTimestamp(max(due, mark + 1))

    timed = event_time(stream, lateness).select(KEY, TIME, *metrics)
    return timed.groupBy(KEY).applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def scored_windows(
    stream: DataFrame, scaler: WindowScaler, limits: tuple[float, float], weights: RiskWeights = RiskWeights(),
    lateness: str = "10 minutes", idle: str = "7 days",
) -> DataFrame:
    """`row_windows` of bounded samples with anomaly score, risk and health, by a fitted scaler and frozen limits.

    The score is the deviation method's. Samples pass one by one, so there is no gap fill and no z-score clip, which need
    the whole series: a window with a missing value has no score. On series without gaps and outliers a device's
    newest window equals `build_fingerprint` with the same limits.
    """
    found = row_windows(clip_bounds(stream), scaler.spec, lateness, idle)
    low, high = (F.lit(x).cast("double") for x in limits)
    scored = found.withColumn("anomaly_score", rescale(scaler.deviation(), low, high))
    return health_score(scored, weights).select(*SCORE_COLUMNS, KEY, WINDOW_END, "window_index", *STAT_COLUMNS)
