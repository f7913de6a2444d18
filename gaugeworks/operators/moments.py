"""Moments of vectors that merge: counts, means and centred cross products as a table, one row for each entry.

Tables of disjoint sets of vectors (tasks, days) merge into that of their union without reading the vectors again. Every
part is centred on its own mean and parts are merged pairwise, so values far from zero lose no digits.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.vectors import matrices

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the vectors whose moments are taken at once: merging costs as much as entries squared, whatever the rows are.
PART_BYTES = 8 << 20
#: Row i over all entries j, for the vectors that know both: how many, means of entry i and of entry j less their bases,
#: sum of products of the deviations from these means; and the bases of all entries. A base is a number close to the
#: mean: the small rest keeps the digits that a mean far from zero has not got.
ROWS = "i int, n array<double>, own array<double>, other array<double>, product array<double>, base array<double>"
NAMES = ("n", "own", "other", "product", "base")


@dataclass(frozen=True)
class Moments:
    """Means and covariance (population) of a column of vectors, over the pairs of entries that are known."""

    count: int
    mean: np.ndarray
    covariance: np.ndarray


#: NAMES as matrices (and the bases as a vector), or as rows i of them.
Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def part_of(x: np.ndarray) -> Part:
    """The moments of the rows of `x`; NaN is missing."""
    known = ~np.isnan(x)
    counts = known.sum(axis=0)
    base = np.where(known, x, 0.0).sum(axis=0) / np.maximum(counts, 1)
    if known.all():
        away = x - base
        n = np.full((x.shape[1], x.shape[1]), float(len(x)))
        sums = np.broadcast_to(away.sum(axis=0)[:, None], n.shape)
    else:
        away, mask = np.where(known, x - base, 0.0), known.astype("float64")
        n, sums = mask.T @ mask, away.T @ mask  # of entry i, where j is known
    own = sums / np.maximum(n, 1.0)
    return n, own, own.T, away.T @ away - sums * own.T, base


def merged(one: Part, two: Part, i: int | None = None) -> Part:
    """The moments of both parts' vectors together: whole matrices, or their rows i."""
    n, m = one[0], two[0]
    total = n + m
    share = m / np.maximum(total, 1.0)
    shift = two[4] - one[4]
    d = (shift[:, None] if i is None else shift[i]) + two[1] - one[1]
    e = shift + two[2] - one[2]
    d, e = np.where(m > 0, d, 0.0), np.where(m > 0, e, 0.0)
    return total, one[1] + d * share, one[2] + e * share, one[3] + two[3] + d * e * n * share, one[4]


def _batch(index, parts) -> pa.RecordBatch:
    columns = [pa.array([list(p[k]) for p in parts], pa.list_(pa.float64())) for k in range(len(NAMES))]
    return pa.record_batch([pa.array(list(index), pa.int32()), *columns], names=["i", *NAMES])


def merge_rows(tables: DataFrame) -> DataFrame:
    """One table of moments from the rows of several; other columns (a day) are ignored."""

    def run(batches):
        found: dict[int, Part] = {}
        for batch in batches:
            columns = [batch.column(k) for k in range(1, 1 + len(NAMES))]
            for at, i in enumerate(batch.column(0).to_pylist()):
                part = tuple(c[at].values.to_numpy() for c in columns)
                found[i] = merged(found[i], part, i) if i in found else part
        if found:
            yield _batch(found, list(found.values()))

    return tables.select("i", *NAMES).repartition("i").mapInArrow(run, ROWS)


def moment_rows(df: DataFrame, values: str) -> DataFrame:
    """The moments of the vectors in `values`, from one pass: every task sends one table, equal rows of them meet.

    Missing entries (NULL or NaN) count for no pair; rows without a vector are left out. No vectors give no rows.
    """

    def partial(batches):
        whole: Part | None = None
        for batch in batches:
            for _, x in matrices(batch.column(0), PART_BYTES):
                part = part_of(x)
                whole = part if whole is None else merged(whole, part)
        if whole is not None:
            yield _batch(range(len(whole[0])), [(*row, whole[4]) for row in zip(*whole[:4], strict=True)])

    return merge_rows(df.select(F.col(values).cast("array<double>")).where(F.col(values).isNotNull()).mapInArrow(partial, ROWS))


def moments_of(rows: DataFrame) -> Moments:
    """One table of moments (`moment_rows`, `merge_rows`) as matrices on the driver: entries squared, whatever the rows were."""
    table = rows.select("i", *NAMES).toArrow().sort_by("i")
    if not len(table):
        raise ValueError("no vectors")
    n, own, _, product, base = (np.array(table.column(c).to_pylist()) for c in NAMES)
    return Moments(int(n.diagonal().max()), base.diagonal() + own.diagonal(), product / np.maximum(n, 1.0))


def vector_moments(df: DataFrame, values: str) -> Moments:
    return moments_of(moment_rows(df, values))


# --- moments of many days ------------------------------------------------------------------------------


def store_moments(rows: DataFrame, path: str, day) -> None:
    """Keep a day's table; a day that is stored again is replaced, others stay."""
    # Not coalesce(1), which would also merge the tasks' tables in one task.
    kept = rows.select("i", *NAMES).withColumn("day", F.lit(day).cast("date")).repartition(1)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_moments(spark: SparkSession, path: str, first=None, last=None) -> DataFrame:
    """The merged table of the stored days from `first` to `last`; only their files are read."""
    rows = spark.read.schema(f"{ROWS}, day date").parquet(path)
    if first is not None:
        rows = rows.where(F.col("day") >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col("day") <= F.lit(last).cast("date"))
    return merge_rows(rows)
