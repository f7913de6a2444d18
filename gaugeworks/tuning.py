"""Session settings that suit these plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Let Spark split generated code of wide rows.

    Thirteen metrics make rows so wide that the code fused for a stage can exceed 8,000 bytes per method.
    HotSpot leaves such methods interpreted, which took 1.4 to 2.2 times as long as code generated per
    operator (a million rows, cleaning and windows); the limit makes Spark choose that for such stages.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


#: Bytes of an Arrow batch of whole texts: by rows, 10,000 texts of a few kilobytes, a task's JVM and its worker hold up to 64 MB each.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def tune_texts(spark: SparkSession) -> SparkSession:
    """Let Spark send Python workers whole texts in batches of about BATCH_BYTES; a longer row is a batch of its own."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return spark
