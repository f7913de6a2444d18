"""Raw telemetry to one scored row per device, and the models this needs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import anomaly
from gaugeworks.operators.cleaning import Samples, clean_samples
from gaugeworks.operators.features import WindowScaler, fit_scaler, scaler_of_moments
from gaugeworks.operators.forest import IsolationForest, fit_forest
from gaugeworks.operators.moments import Moments, moment_rows, moments_of
from gaugeworks.operators.pca import PcaEmbedding, principal_components, rescaled
from gaugeworks.operators.scoring import SCORE_COLUMNS, health_score
from gaugeworks.operators.series import SeriesLayout
from gaugeworks.operators.store import settle
from gaugeworks.operators.windows import VECTOR, WINDOW_INDEX, window_table
from gaugeworks.schema import KEY, METRICS, STAT_COLUMNS, WINDOW_END, RiskWeights, WindowSpec

FOREST = "isolation_forest"
RECONSTRUCTION = "reconstruction_error"
DEVIATION = "deviation"  # reconstruction error of an embedding without components
METHODS = (FOREST, RECONSTRUCTION, DEVIATION)


@dataclass(frozen=True)
class Models:
    """Fitted artifacts. The embedding is tied to the scaler's window shape."""

    scaler: WindowScaler
    embedding: PcaEmbedding | None = None
    forest: IsolationForest | None = None

    def __post_init__(self) -> None:
        expected = self.scaler.spec.size * len(self.scaler.mean)
        if self.embedding is not None and self.embedding.dimensions != expected:
            raise ValueError(
                f"embedding was fitted on vectors of {self.embedding.dimensions}, windows have {expected}"
            )

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        for name in ("scaler", "embedding", "forest"):
            part = getattr(self, name)
            if part is not None:
                part.save(spark, f"{path}/{name}", mode)

    @staticmethod
    def load(spark: SparkSession, path: str, method: str = FOREST) -> "Models":
        return Models(
            WindowScaler.load(spark, f"{path}/scaler"),
            None if method == DEVIATION else PcaEmbedding.load(spark, f"{path}/embedding"),
            IsolationForest.load(spark, f"{path}/forest") if method == FOREST else None,
        )


def sample_windows(
    samples: Samples,
    spec: WindowSpec = WindowSpec(),
    statistics: bool = True,
    scaler: WindowScaler | None = None,
) -> DataFrame:
    """Windows of clean samples; with a scaler also the flat vector of scaled samples."""
    vector: dict[str, Column] | None = None
    if scaler is not None:
        vector = {m: scaler.scaled(m) for m in scaler.mean}
    return samples.each(lambda rows, layout: window_table(rows, layout, spec, statistics, vector))


def fit_models(
    raw: DataFrame,
    spec: WindowSpec = WindowSpec(),
    components: int = 8,
    method: str = FOREST,
    layout: SeriesLayout | None = None,
    **forest_options,
) -> Models:
    """Fit scaler, embedding and forest on the windows of raw telemetry."""
    samples = clean_samples(raw, layout).settled()
    return fit_on_samples(samples, spec, components, method, **forest_options)


def window_moments(samples: Samples, spec: WindowSpec = WindowSpec()) -> DataFrame:
    """The mergeable moments of all windows' unscaled vectors."""
    plain = samples.each(lambda rows, layout: window_table(rows, layout, spec, False, {m: F.col(m) for m in METRICS}))
    return moment_rows(plain, VECTOR)


def linear_models(moments: Moments, spec: WindowSpec, components: int = 8) -> tuple[WindowScaler, PcaEmbedding]:
    """Scaler and components from moments of unscaled window vectors, of one run or merged from stored days."""
    scaler = scaler_of_moments(moments, spec)
    mean, scale = (np.tile([f(m) for m in METRICS], spec.size) for f in (scaler.mean.get, scaler.scale))
    return scaler, principal_components(rescaled(moments, mean, scale), components)


def fit_on_samples(
    samples: Samples,
    spec: WindowSpec = WindowSpec(),
    components: int = 8,
    method: str = FOREST,
    **forest_options,
) -> Models:
    """Fit on clean samples. Two passes read them (moments for scaler and components; the embedding), so they should
    be settled: then no pass shuffles them again. Window vectors, six times as large, are never stored.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == DEVIATION:
        return Models(fit_scaler(sample_windows(samples, spec), spec))
    try:
        moments = moments_of(window_moments(samples, spec))
    except ValueError:
        raise ValueError("cannot fit a scaler: no complete window") from None
    scaler, embedding = linear_models(moments, spec, components)
    if method == RECONSTRUCTION:
        return Models(scaler, embedding)
    keys = [KEY, WINDOW_INDEX]
    vectors = sample_windows(samples, spec, statistics=False, scaler=scaler)
    embedded = settle(embedding.transform(vectors, VECTOR).select(*keys, "embedding"))
    return Models(scaler, embedding, fit_forest(embedded, "embedding", keys, **forest_options))


def raw_anomaly(windows: DataFrame, models: Models, method: str) -> DataFrame:
    """Add `raw_anomaly`, not yet scaled to [0, 1]."""
    if method == DEVIATION:
        return windows.withColumn("raw_anomaly", models.scaler.deviation())
    embedded = models.embedding.transform(windows, VECTOR)
    if method == RECONSTRUCTION:
        raw = models.embedding.reconstruction_error(VECTOR)
    else:
        raw = models.forest.score(windows.sparkSession, F.col("embedding"))
    return embedded.withColumn("raw_anomaly", raw).drop(VECTOR, "embedding")


def build_fingerprint(
    raw: DataFrame,
    models: Models,
    method: str = FOREST,
    weights: RiskWeights = RiskWeights(),
    limits: tuple[float, float] | None = None,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """The latest window of every device with its statistics, anomaly score, risk and health.

    Anomaly scores are relative to all windows of the batch unless frozen `limits` are given. The
    telemetry is read once for that: one slim row per window (its raw measure, and the statistics only
    for a device's last window) is settled, the limits come from it, the last windows are scored.
    """
    return fingerprint_of_samples(clean_samples(raw, layout), models, method, weights, limits)


def fingerprint_of_samples(
    samples: Samples,
    models: Models,
    method: str = FOREST,
    weights: RiskWeights = RiskWeights(),
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """`build_fingerprint` from clean samples."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    scaler = None if method == DEVIATION else models.scaler
    windows = sample_windows(samples, models.scaler.spec, scaler=scaler)
    scored = raw_anomaly(windows, models, method)
    if limits is None:
        current = F.when(F.col("is_latest"), F.struct(WINDOW_END, *STAT_COLUMNS))
        slim = settle(scored.select(KEY, "raw_anomaly", current.alias("current")))
        latest = slim.where("current IS NOT NULL").select(KEY, "raw_anomaly", "current.*")
        if method == FOREST:
            limits = anomaly.min_max(slim, "raw_anomaly")
        elif latest.isEmpty():
            limits = (None, None)
        else:
            limits = tuple(anomaly.quantiles(slim, "raw_anomaly", [0.01, 0.99]))
    else:
        latest = scored.where("is_latest")
    low, high = (F.lit(x).cast("double") for x in limits)
    relative = latest.withColumn("anomaly_score", anomaly.rescale(F.col("raw_anomaly"), low, high))
    return health_score(relative, weights).select(*SCORE_COLUMNS, KEY, WINDOW_END, *STAT_COLUMNS)
