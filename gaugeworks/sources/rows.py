"""Telemetry rows submitted as JSON lines, every field required."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schema import ALL_COLUMNS, METRICS, TELEMETRY, TIME, null_if_nan

REQUEST = ", ".join(
    f"{f.name} {'string' if f.name == TIME else f.dataType.simpleString()}" for f in TELEMETRY
)


def validated_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse strictly; a malformed or incomplete row fails the query with the row in the message."""
    record = F.from_json(F.col(column), REQUEST, {"mode": "FAILFAST"})
    rows = lines.select(F.col(column).alias("_text"), record.alias("r"))
    absent = [F.col(f"r.{c}").isNull() for c in ALL_COLUMNS]
    bad = absent[0]
    for test in absent[1:]:
        bad = bad | test
    message = F.concat(F.lit("Row lacks a required field: "), F.col("_text"))
    checked = rows.withColumn("r", F.when(bad, F.raise_error(message).cast(rows.schema["r"].dataType))
                              .otherwise(F.col("r")))
    return checked.select(
        *[
            F.to_timestamp_ntz(f"r.{c}").alias(c)
            if c == TIME
            else (null_if_nan(F.col(f"r.{c}")) if c in METRICS else F.col(f"r.{c}")).alias(c)
            for c in ALL_COLUMNS
        ]
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    return validated_rows(spark.read.text(path))
