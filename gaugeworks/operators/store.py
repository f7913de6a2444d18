"""Where intermediate tables and model artifacts live."""

from __future__ import annotations

import atexit
import shutil
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a settled table that one bucket should hold, by Spark's own estimate of the plan.
BUCKET_BYTES = 128 << 20
MOST_BUCKETS = 20_000
_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, or the session's warehouse where none is set; all executors see both."""
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")


def own_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, deleted when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        folder = _FOLDERS[application] = f"{checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"

        def clean(context=spark.sparkContext):
            if context._jsc is not None:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            elif urlparse(folder).scheme in ("", "file"):  # the session was stopped first
                shutil.rmtree(urlparse(folder).path, ignore_errors=True)

        atexit.register(clean)
    return _FOLDERS[application]


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage: a Parquet table in the shared folder, so that losing executors is harmless and
    later passes read only the columns they need."""
    spark = df.sparkSession
    folder = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def buckets(df: DataFrame) -> int:
    """Enough for BUCKET_BYTES each by Spark's estimate, at least one for every core. Rows that come from no file have
    no estimate (8 exabytes stand for it); the session's number of shuffle partitions serves them."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // BUCKET_BYTES) if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, wanted))


def settle_grouped(df: DataFrame, keys: list[str], order: str, number: int = 0) -> DataFrame:
    """`settle`, as a table bucketed by `keys`: windows and aggregates over them need no shuffle any more.

    Rows that are in `number` hash partitions by `keys` already are written as they are; without a number, `buckets` chooses.
    """
    spark, number = df.sparkSession, number or buckets(df)
    name = f"settled_{uuid.uuid4().hex}"
    (
        df.repartition(number, *keys)
        .write.bucketBy(number, *keys).sortBy(*keys, order)
        .option("path", f"{own_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    )
    return spark.table(name)
