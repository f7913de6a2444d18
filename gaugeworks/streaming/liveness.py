"""Devices that fall silent, on a stream."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeworks.schema import KEY, TIME

cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = f"{KEY} string, last_seen timestamp, is_down boolean"
STATE = "last_seen timestamp, is_down boolean"


def watch(
    stream: DataFrame, interval_seconds: float = 60.0, allowed: int = 3, lateness: str = "10 minutes"
) -> DataFrame:
    """A row whenever a device goes down (silent for `allowed` intervals of event time) or reports again.

    Only times are needed, so the newest one per device and micro-batch is all the state function keeps.
    """
    patience = int(allowed * interval_seconds * 1000)

    def observe(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        known = state.get if state.exists else None
        if state.hasTimedOut:
            last = pd.Timestamp(known[0])
            state.update((last.to_pydatetime(), True))
            yield pd.DataFrame({KEY: [key[0]], "last_seen": [last], "is_down": [True]})
            return
        newest = max(b[TIME].max() for b in batches)
        last = newest if known is None else max(newest, pd.Timestamp(known[0]))
        returned = known is not None and known[1] and newest > pd.Timestamp(known[0])
        still_down = known is not None and known[1] and not returned
        state.update((last.to_pydatetime(), bool(still_down)))
        if not still_down:
            due = int(last.value // 1_000_000) + patience
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if returned:
            yield pd.DataFrame({KEY: [key[0]], "last_seen": [last], "is_down": [False]})

    timed = stream.where(F.col(KEY).isNotNull()).select(KEY, F.col(TIME).cast("timestamp").alias(TIME))
    return (
        timed.withWatermark(TIME, lateness)
        .groupBy(KEY)
        .applyInPandasWithState(observe, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


class Watcher(StatefulProcessor):
    """One device: the time of its last sample, whether it is down, and one timer for what comes next."""

    def __init__(self, patience: int, forget: int):
        self.patience, self.forget = patience, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last bigint, is_down boolean, due bigint")

    def keep(self, last: int, is_down: bool, before: int | None = None) -> None:
        due = last + (self.forget if is_down else self.patience)
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(due)
        self.state.update((last, is_down, due))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        times = pd.to_datetime(initialState["last_seen"])
        newest = times.idxmax()
        self.keep(int(times[newest].value // 1_000_000), bool(initialState["is_down"][newest]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(b[TIME].max() for b in rows)
        at = int(newest.value // 1_000_000)
        last, is_down, due = self.state.get() if self.state.exists() else (None, False, None)
        if last is not None and at <= last:
            return
        self.keep(at, False, due)
        if is_down:
            yield self.row(key, at, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, is_down, _ = self.state.get()
        if is_down:
            self.state.clear()  # vanished
            return
        self.keep(last, True)
        yield self.row(key, last, True)

    @staticmethod
    def row(key: tuple, last: int, is_down: bool) -> pd.DataFrame:
        return pd.DataFrame({KEY: [key[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "is_down": [is_down]})

    def close(self) -> None:
        pass


def watch_known(
    stream: DataFrame, known: DataFrame | None = None, interval_seconds: float = 60.0, allowed: int = 3,
    lateness: str = "10 minutes", forget: str = "30 days",
) -> DataFrame:
    """`watch` with history and an end: `known` (device, last_seen, is_down), as `counters.liveness` gives it, is what the
    stream starts from, so devices that have been silent since before its start are reported as well. A device that is
    down for `forget` of event time has vanished: its state goes, and it is new when it returns.

    The session needs `use_state_store`. Times are kept to the millisecond.
    """
    timed = stream.where(F.col(KEY).isNotNull()).select(KEY, F.col(TIME).cast("timestamp").alias(TIME))
    start = None
    if known is not None:
        seen = known.where(F.col(KEY).isNotNull() & F.col("last_seen").isNotNull())
        start = seen.select(KEY, F.col("last_seen").cast("timestamp").alias("last_seen"), F.coalesce("is_down", F.lit(False)).alias("is_down")).groupBy(KEY)
    patience = int(allowed * interval_seconds * 1000)
    watcher = Watcher(patience, max(patience + 1, int(pd.Timedelta(forget).total_seconds() * 1000)))
    return timed.withWatermark(TIME, lateness).groupBy(KEY).transformWithStateInPandas(watcher, OUTPUT, "Append", "EventTime", initialState=start)
