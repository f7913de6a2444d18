"""Telemetry files, JSON documents and their sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.schema import ALL_COLUMNS, HOST, KEY, METRICS, TELEMETRY, TIME, null_if_nan


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Columns are found by name, so any order and extra columns are fine."""
    text = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in TELEMETRY}
    return text.select(
        *[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in text.columns]
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {".csv": read_csv, ".parquet": read_parquet, ".pq": read_parquet}


def require_columns(df: DataFrame, required: tuple[str, ...] = ALL_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Input is missing required columns: {missing}")
    return df


def canonical(df: DataFrame) -> DataFrame:
    """The sixteen telemetry columns in order and type, NaN as NULL."""
    types = {f.name: f.dataType for f in TELEMETRY}
    return require_columns(df).select(
        *[
            null_if_nan(F.col(c).cast("double")).alias(c) if c in METRICS else F.col(c).cast(types[c]).alias(c)
            for c in ALL_COLUMNS
        ]
    )


def with_device_key(df: DataFrame, columns: tuple[str, ...] = (HOST, KEY), key: str = KEY) -> DataFrame:
    """`key` becomes one text of several columns, for fleets that number their devices per host.

    Parts are joined by '/', which is written %2F within a part (and % as %25), so different devices never share a text.
    A missing last column leaves the key missing; other missing parts count as `unknown`. All operators then work per
    device of the fleet.
    """
    def part(name: str) -> Column:
        return F.replace(F.replace(F.col(name).cast("string"), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))

    *outer, last = columns
    return df.withColumn(key, F.concat(*[x for c in outer for x in (F.coalesce(part(c), F.lit("unknown")), F.lit("/"))], part(last)))


def load_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Read by suffix, validate, project. An absent path is Spark's PATH_NOT_FOUND error.

    Rows come in no particular order: sort at a sink (`sort_for_sink`) when order is wanted.
    """
    suffix = next((s for s in READERS if path.rstrip("/").endswith(s)), None)
    if suffix is None:
        raise ValueError(f"Unsupported file type: {path}")
    return canonical(READERS[suffix](spark, path))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns by name, absent ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sort_for_sink(df: DataFrame, *order: str | Column) -> DataFrame:
    """Global order by device and time: a range exchange, for use right before writing."""
    return df.orderBy(*(order or (KEY, TIME)))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_document(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each row as one pretty-printed JSON document; timestamps become strings."""
    text = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(text.alias("value")).write.mode(mode).text(path)


def read_document(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)
