"""Landed responses of a metrics server's range query: nested JSON to the wide telemetry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.text import as_double, epoch_to_timestamp
from gaugeworks.schema import ALL_COLUMNS, EXPORTER_METRICS, HOST, KEY, METRICS, TIME

UNKNOWN = "unknown"
SAMPLE_KEYS = [TIME, KEY, HOST]

# A value pair is [number, "text"]; an array of strings accepts both.
RESPONSE_SCHEMA = (
    "data struct<result: array<struct<metric: map<string,string>, values: array<array<string>>>>>"
)


def exporter_name(column: Column) -> Column:
    """Exporter metric behind a telemetry column name; NULL for other names."""
    pairs = [F.lit(x) for pair in EXPORTER_METRICS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), column)


def column_name(exporter_metric: Column) -> Column:
    pairs = [F.lit(x) for name, metric in EXPORTER_METRICS.items() for x in (metric, name)]
    return F.try_element_at(F.create_map(*pairs), exporter_metric)


def flatten_response(responses: DataFrame, *keep: str) -> DataFrame:
    """One row per sample: (timestamp, gpu_id, node_id, value), plus the columns in `keep`."""
    series = responses.select(*keep, F.explode("data.result").alias("series"))
    label = F.col("series.metric")
    samples = series.select(
        *keep,
        F.coalesce(label["gpu"], label["gpu_id"], F.lit(UNKNOWN)).alias(KEY),
        F.coalesce(label["instance"], label["node"], F.lit(UNKNOWN)).alias(HOST),
        F.explode("series.values").alias("pair"),
    )
    return samples.select(
        *keep,
        epoch_to_timestamp(F.col("pair")[0]).alias(TIME),
        KEY,
        HOST,
        as_double(F.col("pair")[1]).alias("value"),
    )


def read_responses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Long table (metric, timestamp, gpu_id, node_id, value) from one path per telemetry column."""
    unknown = sorted(set(paths) - set(METRICS))
    if unknown:
        raise ValueError(f"Unknown metrics: {unknown}")
    parts = []
    for metric, path in paths.items():
        landed = spark.read.schema(RESPONSE_SCHEMA).option("multiLine", True).json(path)
        parts.append(flatten_response(landed.withColumn("metric", F.lit(metric)), "metric"))
    if not parts:
        empty = "metric string, timestamp timestamp_ntz, gpu_id string, node_id string, value double"
        return spark.createDataFrame([], empty)
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long


def assemble_wide(
    long: DataFrame, metrics: tuple[str, ...] = METRICS, seq: str | None = None
) -> DataFrame:
    """Long to wide in one aggregation over all metrics; metrics without data are NULL columns.

    Of repeated samples of one metric the first by `seq` counts (without `seq`, the smallest value).
    """
    order = F.col(seq) if seq else F.col("value")
    return (
        long.groupBy(*SAMPLE_KEYS)
        .agg(
            *[
                F.min_by("value", F.when(F.col("metric") == m, order)).alias(m)
                if m in metrics
                else F.lit(None).cast("double").alias(m)
                for m in METRICS
            ]
        )
        .select(*ALL_COLUMNS)
    )


def outer_join_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two metric tables on time, device and host.

    Written as left join plus the unmatched right rows: unlike a full join, both can be split by
    adaptive execution when one key is hot.
    """
    extra = right.join(left.select(*SAMPLE_KEYS), SAMPLE_KEYS, "left_anti")
    return left.join(right, SAMPLE_KEYS, "left").unionByName(extra, allowMissingColumns=True)
