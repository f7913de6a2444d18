"""Telemetry read from a generic event table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schema import ALL_COLUMNS, SEQ


def telemetry_from_events(events: DataFrame) -> DataFrame:
    """One telemetry row per event: the user is the device; value, props and the ids drive thirteen independent metrics."""
    k, v, kind = F.col("k"), F.col("value"), F.col("event_type")
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("double")

    def share(event: int, user: int) -> Column:
        """A number from 0 up to 1 from the ids; every pair of factors gives an independent column."""
        return ((F.col("event_id") * event + F.col("user_id") * user) % 997).cast("double") / 997.0

    return events.withColumn("k", number).select(
        F.col("event_id").alias(SEQ),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("gpu-"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("gpu_id"),
        F.concat(F.lit("node-"), F.lpad((F.col("user_id") % 8).cast("string"), 2, "0")).alias("node_id"),
        F.when((kind == "signup") & (k < 25), none).otherwise(v).alias("gpu_util"),
        (100.0 * share(7, 3)).alias("mem_util"),
        F.when((kind == "error") & (k < 20), none).otherwise(25.0 + 70.0 * share(11, 5)).alias("gpu_temp"),
        (60.0 + 500.0 * share(13, 17)).alias("power_watts"),
        F.when(kind == "error", F.floor(30.0 * share(19, 2)).cast("double")).otherwise(zero).alias("ecc_errors"),
        F.when((kind == "error") & (k >= 80), F.floor(9.0 * share(23, 29)).cast("double")).otherwise(zero).alias("xid_errors"),
        k.alias("cpu_util"),
        (100.0 * share(31, 11)).alias("ram_util"),
        (800.0 * share(37, 13)).alias("net_throughput_mbps"),
        (250.0 * share(41, 19)).alias("disk_io_mbps"),
        (7200.0 * share(43, 23)).alias("job_runtime_s"),
        F.floor(12.0 * share(47, 31)).cast("double").alias("queue_length"),
        (1.0 + F.floor(9.0 * share(53, 37))).cast("double").alias("active_processes"),
    )


def read_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return telemetry_from_events(events).select(SEQ, *ALL_COLUMNS)
