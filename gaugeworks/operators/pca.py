"""Principal-component embedding of flattened windows (or any fixed-length vectors), fitted in one pass."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.moments import Moments, vector_moments
from gaugeworks.operators.vectors import projected

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class PcaEmbedding:
    """Fitted components, one list per component, and the mean they are measured from."""

    components: list[list[float]]
    mean: list[float]
    explained: list[float]

    @property
    def dimensions(self) -> int:
        return len(self.mean)

    def transform(self, df: DataFrame, values: str, embedding: str = "embedding") -> DataFrame:
        """Add the centred projection of an array column as an array column; NULL for incomplete vectors."""
        model = df.sparkSession.sparkContext.broadcast((np.array(self.components).T, np.array(self.mean)))

        @F.arrow_udf("array<double>")
        def project(vectors: pa.Array) -> pa.Array:
            components, mean = model.value
            return projected(vectors, lambda points: (points - mean) @ components)

        return df.withColumn(embedding, project(F.col(values)))

    def reconstruction_error(self, values: str, embedding: str = "embedding") -> Column:
        """Mean squared error of the back-projection.

        Components are orthonormal, so it is what the projection leaves of the centred squared length.
        """
        mean = F.array(*[F.lit(m) for m in self.mean])
        centred = F.zip_with(F.col(values).cast("array<double>"), mean, lambda x, m: (x - m) * (x - m))
        length = F.aggregate(centred, F.lit(0.0), lambda s, x: s + x)
        kept = F.aggregate(F.col(embedding), F.lit(0.0), lambda s, z: s + z * z)
        return F.greatest((length - kept) / len(self.mean), F.lit(0.0))

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        row = [(self.components, self.mean, self.explained)]
        schema = "components array<array<double>>, mean array<double>, explained array<double>"
        spark.createDataFrame(row, schema).coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PcaEmbedding":
        row = spark.read.parquet(path).first()
        return PcaEmbedding([list(c) for c in row["components"]], list(row["mean"]), list(row["explained"]))


def principal_components(moments: Moments, k: int) -> PcaEmbedding:
    """The `k` largest eigenvectors of the covariance; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh((moments.covariance + moments.covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    components = vectors[:, order].T
    signs = np.sign(components[np.arange(len(order)), np.abs(components).argmax(axis=1)])
    total = max(float(np.clip(values, 0, None).sum()), 1e-300)
    return PcaEmbedding(
        (components * signs[:, None]).tolist(), moments.mean.tolist(), [float(max(values[i], 0.0)) / total for i in order]
    )


def fit_pca(df: DataFrame, values: str, k: int = 8) -> PcaEmbedding:
    return principal_components(vector_moments(df, values), k)


def rescaled(moments: Moments, mean: np.ndarray, scale: np.ndarray) -> Moments:
    """The moments of (vector - mean) / scale: scaling is affine, so no second pass is needed."""
    return Moments(moments.count, (moments.mean - mean) / scale, moments.covariance / np.outer(scale, scale))
