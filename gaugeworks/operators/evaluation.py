"""Detection trials and model quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.text import id_list


def trial_counts(trials: DataFrame, actual: str, flagged: str, *keep: str) -> DataFrame:
    """True positives, false positives and false negatives per trial from two id lists."""
    ids = trials.select(*keep, id_list(F.col(actual)).alias("a"), id_list(F.col(flagged)).alias("f"))
    return ids.select(
        *keep,
        F.size(F.array_intersect("a", "f")).cast("bigint").alias("tp"),
        F.size(F.array_except("f", "a")).cast("bigint").alias("fp"),
        F.size(F.array_except("a", "f")).cast("bigint").alias("fn"),
    )


def detection_counts(
    outcomes: DataFrame, is_failing: Column, is_flagged: Column, *group: str
) -> DataFrame:
    """The same counts from one row per (trial, device), without building id lists."""
    return outcomes.groupBy(*group).agg(
        F.count_if(is_failing & is_flagged).alias("tp"),
        F.count_if(~is_failing & is_flagged).alias("fp"),
        F.count_if(is_failing & ~is_flagged).alias("fn"),
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """Precision and recall over all trials; undefined shares are NULL."""
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "tp",
        "fp",
        "fn",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )


def accuracy(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return predictions.agg(F.avg(hit).alias("accuracy"))


def mean_squared_error(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean over all entries of two equally long array columns."""
    gap = F.aggregate(
        F.zip_with(actual, predicted, lambda a, p: (a - p) * (a - p)), F.lit(0.0), lambda s, d: s + d
    )
    return pairs.agg((F.sum(gap) / F.sum(F.size(actual))).alias("mse"))
