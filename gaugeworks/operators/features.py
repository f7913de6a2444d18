"""Scaling fitted on windows, and splits for training."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.moments import Moments
from gaugeworks.schema import METRICS, WindowSpec


@dataclass(frozen=True)
class WindowScaler:
    """Mean and population deviation per metric over all window elements of the fitted windows."""

    mean: dict[str, float]
    std: dict[str, float]
    spec: WindowSpec = WindowSpec()

    def scale(self, metric: str) -> float:
        return self.std[metric] or 1.0

    def scaled(self, metric: str) -> Column:
        return (F.col(metric) - F.lit(self.mean[metric])) / F.lit(self.scale(metric))

    def transform(self, df: DataFrame) -> DataFrame:
        """Standardise every fitted metric of a table of samples."""
        return df.select(*[self.scaled(c).alias(c) if c in self.mean else F.col(c) for c in df.columns])

    def inverse(self, df: DataFrame) -> DataFrame:
        def back(m: str) -> Column:
            return F.col(m) * F.lit(self.scale(m)) + F.lit(self.mean[m])

        return df.select(*[back(c).alias(c) if c in self.mean else F.col(c) for c in df.columns])

    def deviation(self) -> Column:
        """Mean squared standardised value of a window, from its statistics."""
        terms = [
            (F.pow(F.col(f"{m}_mean") - self.mean[m], 2) + F.pow(F.col(f"{m}_std"), 2))
            / F.lit(self.scale(m) ** 2)
            for m in self.mean
        ]
        return sum(terms[1:], start=terms[0]) / len(terms)

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        rows = [(m, self.mean[m], self.std[m], self.spec.size, self.spec.stride) for m in self.mean]
        schema = "metric string, mean double, std double, size int, stride int"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "WindowScaler":
        rows = {r["metric"]: r for r in spark.read.parquet(path).collect()}
        if not rows:
            raise ValueError(f"no scaler in {path}")
        names = [m for m in METRICS if m in rows]
        first = rows[names[0]]
        return WindowScaler(
            {m: rows[m]["mean"] for m in names},
            {m: rows[m]["std"] for m in names},
            WindowSpec(first["size"], first["stride"]),
        )


def scaler_moments(windows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row with `mean_*` and `std_*` over all elements of all windows.

    All windows are equally long, so the elements' variance is the mean of the windows' variances
    plus the variance of their means: no window has to be spelled out again.
    """
    return windows.agg(
        *[F.expr(f"avg({m}_mean) AS mean_{m}") for m in metrics],
        *[
            F.expr(f"sqrt(avg({m}_std * {m}_std) + var_pop({m}_mean)) AS std_{m}")
            for m in metrics
        ],
    )


def fit_scaler(
    windows: DataFrame, spec: WindowSpec = WindowSpec(), metrics: tuple[str, ...] = METRICS
) -> WindowScaler:
    row = scaler_moments(windows, metrics).first()
    if row[f"mean_{metrics[0]}"] is None:
        raise ValueError("cannot fit a scaler: no complete window")
    return WindowScaler(
        {m: row[f"mean_{m}"] for m in metrics}, {m: row[f"std_{m}"] for m in metrics}, spec
    )


def scaler_of_moments(moments: Moments, spec: WindowSpec, metrics: tuple[str, ...] = METRICS) -> WindowScaler:
    """The scaler from the moments of unscaled window vectors, whose entries go sample by sample."""
    mean = moments.mean.reshape(spec.size, len(metrics))
    within = moments.covariance.diagonal().reshape(spec.size, len(metrics)).mean(axis=0)
    whole = mean.mean(axis=0)
    spread = np.sqrt(np.maximum(within, 0.0) + ((mean - whole) ** 2).mean(axis=0))
    # What is left of a constant metric is rounding.
    spread = np.where(spread <= 1e-14 * np.abs(whole), 0.0, spread)
    return WindowScaler(dict(zip(metrics, whole.tolist(), strict=True)), dict(zip(metrics, spread.tolist(), strict=True)), spec)


def window_memberships(position: Column, length: Column, spec: WindowSpec) -> Column:
    """Number of windows that contain the sample at a 0-based position of a series."""
    last_start = F.least(position, length - spec.size)
    first_start = F.greatest(position - (spec.size - 1), F.lit(0))
    count = F.floor(last_start / spec.stride) - F.ceil(first_start / spec.stride) + 1
    return F.when(length >= spec.size, F.greatest(count, F.lit(0))).otherwise(F.lit(0)).cast("bigint")


def is_validation(columns: list[str], percent: int = 15, seed: int = 42) -> Column:
    """Deterministic split: true for about `percent` % of the distinct values of `columns`.

    By the first eight hex digits of an MD5 hash, which other engines have as well. Split by device to keep
    overlapping windows on one side.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % 100 < percent
