"""Nonlinear reconstruction error: random Fourier features and their principal components.

Cosines of random projections approximate a Gaussian kernel, so components of these features follow curved sets that
components of the vectors themselves cannot. Fitting is one pass of mergeable moments over the features; what the
components leave of a row's features is its error, which takes the place of a neural net's reconstruction.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.moments import moment_rows, moments_of, vector_moments
from gaugeworks.operators.pca import PcaEmbedding, principal_components
from gaugeworks.operators.vectors import projected

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class FourierModel:
    """Weights [feature][entry] and a phase for every feature, and the components of the features."""

    weights: list[list[float]]
    phases: list[float]
    components: PcaEmbedding | None = None

    def features(self, df: DataFrame, values: str, name: str = "features") -> DataFrame:
        """Add sqrt(2 / n) cos(weights x + phase) for n features as an array; NULL for incomplete vectors."""
        model = df.sparkSession.sparkContext.broadcast((np.array(self.weights).T, np.array(self.phases)))

        @F.arrow_udf("array<double>")
        def waves(vectors: pa.Array) -> pa.Array:
            weights, phases = model.value
            return projected(vectors, lambda points: np.sqrt(2.0 / len(phases)) * np.cos(points @ weights + phases), np.isfinite)

        return df.withColumn(name, waves(F.col(values)))

    def error(self, df: DataFrame, values: str, name: str = "error") -> DataFrame:
        """Add the mean squared part of the centred features that the components leave; NULL for incomplete vectors."""
        if self.components is None:
            raise ValueError("the model has no components yet")
        waves, embedding = "_waves", "_embedding"
        found = self.components.transform(self.features(df, values, waves), waves, embedding)
        return found.withColumn(name, self.components.reconstruction_error(waves, embedding)).drop(waves, embedding)

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        if self.components is None:
            raise ValueError("the model has no components yet")
        schema = "weights array<array<double>>, phases array<double>"
        spark.createDataFrame([(self.weights, self.phases)], schema).coalesce(1).write.mode(mode).parquet(f"{path}/waves")
        self.components.save(spark, f"{path}/components", mode)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FourierModel":
        row = spark.read.parquet(f"{path}/waves").first()
        return FourierModel([list(w) for w in row["weights"]], list(row["phases"]), PcaEmbedding.load(spark, f"{path}/components"))


def drawn_waves(entries: int, features: int, width: float, seed: int) -> FourierModel:
    """Features whose products approximate exp(-|x - y|^2 / (2 width^2))."""
    pick = np.random.default_rng(seed)
    weights = pick.normal(size=(features, entries)) / width
    return FourierModel(weights.tolist(), pick.uniform(0, 2 * np.pi, features).tolist())


def fit_fourier(df: DataFrame, values: str, features: int = 256, components: int = 16, width: float | None = None, seed: int = 42) -> FourierModel:
    """Fit on an array column. Without a `width` the root of the vectors' total variance is taken (one more pass).

    Work grows with rows x features; the driver gets one matrix of features squared. Vectors may be window vectors, but
    an embedding of them is much cheaper.
    """
    moments = vector_moments(df, values)
    if width is None:
        width = float(np.sqrt(max(np.trace(moments.covariance), 0.0))) or 1.0
    waves = drawn_waves(len(moments.mean), features, width, seed)
    found = principal_components(moments_of(moment_rows(waves.features(df, values).where("features IS NOT NULL"), "features")), components)
    return FourierModel(waves.weights, waves.phases, found)
