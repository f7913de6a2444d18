"""Workload classifier (Spark ML) and demand forecaster (one pass of cross products)."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import workload_label, workload_name
from gaugeworks.operators.moments import vector_moments
from gaugeworks.operators.vectors import projected
from gaugeworks.schema import STAT_COLUMNS, WORKLOAD_CLASSES

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = "_features"
SCALED = "_scaled"


def classifier_features(windows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """The embedding followed by the 39 raw statistics as one array, and the weak label."""
    joined = F.concat(F.col(embedding), F.array(*[F.col(c) for c in STAT_COLUMNS]))
    return windows.withColumn("features", joined).withColumn(
        "label", workload_label(F.col("gpu_util_mean"))
    )


def fit_classifier(
    training: DataFrame, inputs: int, hidden: int = 32, max_iter: int = 50, seed: int = 42
) -> PipelineModel:
    """Perceptron inputs -> hidden -> hidden / 2 -> 4 over standardised `features`."""
    rows = training.where(F.col("features").isNotNull()).select(
        array_to_vector("features").alias(FEATURES), F.col("label").cast("double").alias("label")
    )
    net = MultilayerPerceptronClassifier(
        layers=[inputs, hidden, hidden // 2, len(WORKLOAD_CLASSES)],
        featuresCol=SCALED,
        maxIter=max_iter,
        seed=seed,
    )
    scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True)
    return Pipeline(stages=[scaler, net]).fit(rows)


def classify(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Add `predicted_label` and `workload_class`."""
    scored = model.transform(windows.withColumn(FEATURES, array_to_vector("features")))
    label = F.col("prediction").cast("int")
    return (
        scored.withColumn("predicted_label", label)
        .withColumn("workload_class", workload_name(label))
        .drop(FEATURES, SCALED, "rawPrediction", "probability", "prediction")
    )


@dataclass(frozen=True)
class DemandForecaster:
    """A linear model for every entry of the flat target `y` (step by step, target by target)."""

    weights: list[list[float]]
    intercept: list[float]

    def forecast(self, sequences: DataFrame) -> DataFrame:
        """Add `forecast`, laid out like `y`; NULL for incomplete inputs."""
        model = sequences.sparkSession.sparkContext.broadcast((np.array(self.weights), np.array(self.intercept)))

        @F.arrow_udf("array<double>")
        def ahead(inputs: pa.Array) -> pa.Array:
            weights, intercept = model.value
            return projected(inputs, lambda x: x @ weights.T + intercept)

        return sequences.withColumn("forecast", ahead("x"))

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        schema = "weights array<array<double>>, intercept array<double>"
        spark.createDataFrame([(self.weights, self.intercept)], schema).coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DemandForecaster":
        row = spark.read.parquet(path).first()
        return DemandForecaster([list(w) for w in row["weights"]], list(row["intercept"]))


def fit_forecaster(training: DataFrame, outputs: int, regularization: float = 1e-3) -> DemandForecaster:
    """Direct multi-step regression from lookback inputs `x` to every future value in `y`.

    One pass sums the cross products of inputs and targets; the ridge (on standardised inputs) is solved on the driver
    for all targets at once.
    """
    whole = training.select(F.concat(F.col("x"), F.slice("y", 1, outputs)).alias("xy"))
    moments = vector_moments(whole, "xy")
    inputs = len(moments.mean) - outputs
    spread = np.sqrt(np.maximum(moments.covariance.diagonal()[:inputs], 0.0))
    spread = np.where(spread > 1e-12, spread, 1.0)
    among = moments.covariance[:inputs, :inputs] / np.outer(spread, spread)
    across = moments.covariance[:inputs, inputs:] / spread[:, None]
    weights = np.linalg.solve(among + regularization * np.eye(inputs), across) / spread[:, None]
    intercept = moments.mean[inputs:] - moments.mean[:inputs] @ weights
    return DemandForecaster(weights.T.tolist(), intercept.tolist())
