"""Fingerprints day by day: a run reads the rows that are left open and the new samples, never the older files.

Series operators need little of the past: the samples that the next window reaches back to, those with a gap that still
waits for a valid value, and the position of the next sample. These are a table with about `size` rows per device.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gaugeworks.operators import limits as kept_limits
from gaugeworks.operators.cleaning import Samples, clip_bounds, fill_gaps, group_samples
from gaugeworks.operators.features import WindowScaler
from gaugeworks.operators.moments import moment_rows, store_moments
from gaugeworks.operators.scoring import SCORE_COLUMNS, health_score
from gaugeworks.operators.series import LENGTH, POSITION, SeriesLayout, measure, parts
from gaugeworks.operators.store import settle
from gaugeworks.operators.windows import VECTOR, WINDOW_INDEX, latest_per_device, window_table
from gaugeworks.functions.numeric import rescale
from gaugeworks.schema import KEY, METRICS, SEQ, STAT_COLUMNS, TIME, WINDOW_END, RiskWeights, WindowSpec

CLOSED = "_closed"
PLACE = "_place"
KEPT = "_kept"
STATE = f"{KEY} string, {TIME} timestamp_ntz, {POSITION} bigint, {CLOSED} bigint, " + ", ".join(f"{m} double" for m in METRICS)


@dataclass(frozen=True)
class Step:
    """What one run gives: the newly closed samples, clean and placed in their series, and the open rows for the next."""

    samples: Samples
    state: DataFrame
    spec: WindowSpec

    def windows(self, statistics: bool = True, vector_of=None) -> DataFrame:
        """The windows that this run completes. `is_latest` is relative to what is known so far."""
        return self.samples.each(lambda rows, own: window_table(rows, own, self.spec, statistics, vector_of))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(STATE)])


def advance(
    state: DataFrame, new: DataFrame, spec: WindowSpec = WindowSpec(), until: datetime | None = None, hold: timedelta = timedelta(days=1),
    profile: DataFrame | None = None, z_threshold: float = 5.0, finish: bool = False,
) -> Step:
    """One run over `new` raw samples, from the open rows `state` (`empty_state` at first).

    Cleaning is that of `preprocess`: the last copy wins within a run, gaps are filled by position, values are clipped
    to bounds and, with a `device_profile`, to `z_threshold` deviations from frozen moments. A sample is closed when a
    valid value of every metric has followed or was there, when it is older than `until` less `hold`, or with `finish`, which
    ends all series as a batch does: run after run then gives what one run over everything gives. Samples not newer than
    what their device has are late and dropped. Windows need two samples at least.
    """
    if spec.size < 2:
        raise ValueError("windows of one sample need no state")
    metrics = list(METRICS)
    heads = settle(state.groupBy(KEY).agg(F.min(POSITION).alias("_first"), F.max(TIME).alias("_last"), F.max(CLOSED).alias("_before")))
    names = [c for c in (SEQ, TIME, KEY, *metrics) if c in new.columns]
    seq = SEQ if SEQ in names else None
    fresh = new.select(*names).where(F.col(KEY).isNotNull()).join(heads.select(KEY, "_last"), KEY, "left")
    fresh = fresh.where(F.col("_last").isNull() | (F.col(TIME) > F.col("_last"))).drop("_last")
    # Open rows keep their place: they are no copies of each other nor of new samples.
    held = state.select(KEY, TIME, *metrics, F.col(POSITION).alias(PLACE))
    together = fresh.withColumn(PLACE, F.lit(None).cast("bigint")).unionByName(held, allowMissingColumns=True)
    late = F.lit(None if until is None else until - hold).cast("timestamp_ntz")

    def placed(rows: DataFrame, own: SeriesLayout) -> DataFrame:
        """Every sample once with its clean value, if it is closed, and what the next run needs of it (NULL: nothing)."""
        raw = group_samples(rows, own, seq, PLACE).drop(PLACE).withColumn("_raw", F.struct(*metrics))
        filled = fill_gaps(raw, own, metrics)
        valid = {f"_at_{m}": F.max(F.when(F.col(f"_raw.{m}").isNotNull(), F.col(POSITION))) for m in metrics}
        ends = {"_n": F.count(F.lit(1)), "_held": F.count_if(F.col(TIME) <= late)} | ({} if finish else valid)
        if own.is_cut:
            filled = settle(filled)
            filled = filled.join(filled.groupBy(KEY).agg(*[c.alias(name) for name, c in ends.items()]), KEY)
        else:
            filled = filled.select("*", *[c.over(Window.partitionBy(KEY)).alias(name) for name, c in ends.items()])
        first = F.coalesce("_first", F.lit(0))
        full = F.col("_n") if finish else F.least(*[F.coalesce(c, F.lit(-1)) for c in valid]) + 1
        known = filled.join(heads.drop("_last"), KEY, "left").withColumn(POSITION, F.col(POSITION) + first)
        known = known.withColumn(CLOSED, F.greatest(full + first, F.col("_held") + first, F.coalesce("_before", F.lit(0))).cast("bigint"))
        is_closed = F.col(POSITION) < F.col(CLOSED)
        # Bounds clip what is closed only: open rows go on as they came.
        kept = F.struct(*[F.when(is_closed, F.col(m)).otherwise(F.col(f"_raw.{m}")).alias(m) for m in metrics])
        known = known.withColumn(KEPT, F.when(F.col(POSITION) >= F.col(CLOSED) - (spec.size - 1), kept))
        clean = clip_bounds(known.select(KEY, TIME, POSITION, CLOSED, KEPT, *own.group[1:], *metrics))
        return clean if profile is None else clip_by_profile(clean, profile, z_threshold)

    layout = measure(together).in_buckets(new.sparkSession.sparkContext.defaultParallelism)
    tables = Samples(tuple((placed(rows, own), own) for rows, own in parts(together, layout))).settled()
    closed = F.col(POSITION) < F.col(CLOSED)
    samples = [(rows.where(closed).select(KEY, TIME, POSITION, F.col(CLOSED).alias(LENGTH), *metrics), own) for rows, own in tables.tables]
    left = tables.each(lambda rows, _: rows.where(F.col(KEPT).isNotNull()).select(KEY, TIME, POSITION, CLOSED, *[f"{KEPT}.{m}" for m in metrics]))
    return Step(Samples(tuple(samples)), left, spec)


def clip_by_profile(samples: DataFrame, profile: DataFrame, z_threshold: float) -> DataFrame:
    """Outliers by their device's frozen moments (arrays in the order of METRICS); other devices stay as they are."""
    joined = samples.join(profile.select(KEY, F.col("mean").alias("_mean"), F.col("std").alias("_std")), KEY, "left")

    def clamped(m: str, i: int) -> str:
        mean, std = f"_mean[{i}]", f"_std[{i}]"
        return (
            f"CASE WHEN {std} > 0 AND NOT isnan({std}) AND abs(({m} - {mean}) / {std}) > {z_threshold}D"
            f" THEN least(greatest({m}, {mean} - {z_threshold}D * {std}), {mean} + {z_threshold}D * {std}) ELSE {m} END AS {m}"
        )

    at = {m: i for i, m in enumerate(METRICS)}
    return joined.selectExpr(*[clamped(c, at[c]) if c in at else c for c in samples.columns])


# --- runs over stored tables ---------------------------------------------------------------------------


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table of numbered folders: those whose write was committed."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        number = re.fullmatch(r"run=(\d+)", status.getPath().getName())
        if number and files.exists(context._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(number[1]))
    return sorted(found)


def run_day(
    spark: SparkSession, path: str, new: DataFrame, day: str, scaler: WindowScaler, spec: WindowSpec | None = None, **options
) -> DataFrame:
    """One day's run over the tables under `path`; returns the day's new windows.

    Written are the windows (statistics and raw deviation), the moments of their vectors, the sketch of their deviation
    for limits, the newest window of every device, and last the open rows: a run that was killed before that is done
    again from the same state and replaces its own files. Read are the last open rows, the last newest windows and `new`.
    """
    spec = spec or scaler.spec
    done = versions(spark, f"{path}/state")
    number = done[-1] + 1 if done else 0
    state = spark.read.schema(STATE).parquet(f"{path}/state/run={done[-1]}") if done else empty_state(spark)
    step = advance(state, new, spec, **options)
    plain = {m: F.col(m) for m in METRICS}

    folder = f"{path}/windows/run={number}"
    found = step.windows().withColumn("raw_anomaly", scaler.deviation())
    found.select(KEY, WINDOW_END, WINDOW_INDEX, "raw_anomaly", *STAT_COLUMNS).write.mode("overwrite").parquet(folder)
    windows = spark.read.parquet(folder)
    store_moments(moment_rows(step.windows(False, plain), VECTOR), f"{path}/moments", day)
    kept_limits.store_sketch(windows, "raw_anomaly", f"{path}/limits", day)
    newest = windows.drop(WINDOW_INDEX)
    if done:
        newest = spark.read.parquet(f"{path}/newest/run={done[-1]}").unionByName(newest)
    latest_per_device(newest).write.mode("overwrite").parquet(f"{path}/newest/run={number}")
    step.state.write.mode("overwrite").parquet(f"{path}/state/run={number}")
    return windows


def current_fingerprint(
    spark: SparkSession, path: str, limits: Callable[[], tuple[float, float]] | tuple[float, float], weights: RiskWeights = RiskWeights(),
) -> DataFrame:
    """The newest window of every device as of the last complete run, scored between `limits`; reads one small table."""
    done = versions(spark, f"{path}/state")
    if not done:
        raise ValueError(f"no complete run in {path}")
    low, high = (F.lit(x).cast("double") for x in (limits() if callable(limits) else limits))
    newest = spark.read.parquet(f"{path}/newest/run={done[-1]}")
    scored = newest.withColumn("anomaly_score", rescale(F.col("raw_anomaly"), low, high))
    return health_score(scored, weights).select(*SCORE_COLUMNS, KEY, WINDOW_END, *STAT_COLUMNS)
