"""Splitting of per-device series.

Every cleaning and windowing operator works along the samples of one device. Devices are normally
short enough to be one group each. A device that is much longer than the others (a shared id such as
`unknown` can hold a third of all rows) would be a single huge task, so its samples are cut into spans by
rank; what crosses a span boundary travels in a table with one row per span. Long devices are processed apart
from the others (`parts`), which keep the cheaper form.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.store import MOST_BUCKETS, settle
from gaugeworks.schema import KEY, TIME

SPAN = "_span"
#: Rows of a task that holds several short spans.
RANGE_ROWS = 250_000
#: Rows of a bucket of a table that is settled by device.
BUCKET_ROWS = 500_000
POSITION = "_position"
LENGTH = "_length"


@dataclass(frozen=True)
class SeriesLayout:
    """Which devices are cut into spans: a settled table of their names, into how many spans in all, and of how many rows.

    `rows` are those of all devices, as far as counted. With `tasks`, rows are dealt to that many tasks, else as Spark chooses.
    """

    key: str = KEY
    time: str = TIME
    long: DataFrame | None = field(default=None, repr=False, compare=False)
    spans: int = 0
    span_rows: int = 250_000
    rows: int = field(default=0, compare=False)
    tasks: int = field(default=0, compare=False)

    def in_buckets(self, least: int) -> SeriesLayout:
        """With a task, later a bucket, for every BUCKET_ROWS counted rows, `least` at least: one exchange serves cleaning and settling."""
        return replace(self, tasks=min(MOST_BUCKETS, max(least, -(-self.rows // BUCKET_ROWS))))

    def by_group(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.tasks, *self.group) if self.tasks else df.repartition(*self.group)

    @property
    def is_cut(self) -> bool:
        return self.long is not None

    @property
    def group(self) -> list[str]:
        """Columns that identify one task-sized group of rows."""
        return [self.key, SPAN] if self.is_cut else [self.key]

    def ordered(self):
        return Window.partitionBy(*self.group).orderBy(F.col(self.time).asc_nulls_last())

    def running(self, descending: bool = False) -> str:
        """SQL frame from the first (last, when descending) sample of the group to the current one.

        Looking ahead uses the descending order: a frame that ends at the last row would be
        evaluated again for every row.
        """
        direction = "DESC NULLS FIRST" if descending else "ASC NULLS LAST"
        return (
            f"(PARTITION BY {', '.join(self.group)} ORDER BY {self.time} {direction}"
            " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )

    def attach(self, df: DataFrame) -> DataFrame:
        """Distribute rows by group and add the span number, which grows with time within a device.

        Uncut: by device, without a number. Cut: ranges of (device, time) with about equal numbers of rows, whatever
        the times are; the ranges are settled, as they are drawn anew whenever Spark computes them. Every range is a task and a
        file, so short spans do not get one each: they are cut from a range by the ranks of a device's rows in it. Rows of
        equal device and time are in one span, so copies should be dropped before.
        """
        if not self.is_cut:
            return self.by_group(df)
        time = F.col(self.time).asc_nulls_last()
        ranges = self.ranges(df.sparkSession.sparkContext.defaultParallelism)
        numbered = df.repartitionByRange(ranges, F.col(self.key), time).withColumn(SPAN, F.spark_partition_id().cast("bigint"))
        if ranges < self.spans:
            within = F.rank().over(Window.partitionBy(*self.group).orderBy(time)) - 1
            numbered = numbered.withColumn(SPAN, F.col(SPAN) * 2**32 + F.floor(within / self.span_rows))
        return self.by_group(settle(numbered))

    def ranges(self, least: int) -> int:
        """Tasks that deal rows to spans: `least` or more of up to RANGE_ROWS rows, but no more than there are spans."""
        return min(self.spans, max(least, -(-self.spans * self.span_rows // RANGE_ROWS)))


def measure(
    df: DataFrame,
    key: str = KEY,
    time: str = TIME,
    long_rows: int = 2_000_000,
    span_rows: int = 250_000,
) -> SeriesLayout:
    """Count rows per device (reads one column) and decide which devices to cut: those above `long_rows`.

    The driver gets how many there are and their rows, about `span_rows` for each span. Only if there are any, their names
    are settled as a table.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    long = counts.where(F.col("_rows") > long_rows)
    is_long = F.col("_rows") > long_rows
    devices, rows, total = counts.agg(F.count_if(is_long), F.sum(F.when(is_long, F.col("_rows"))), F.sum("_rows")).first()
    if not devices:
        return SeriesLayout(key, time, rows=total or 0)
    return SeriesLayout(key, time, settle(long.select(key)), max(1, -(-rows // span_rows)), span_rows, total)


def over_earlier_spans(layout: SeriesLayout, later: bool = False) -> str:
    """SQL frame over the earlier (later) spans of a device; for span tables, not for samples."""
    direction = "DESC" if later else "ASC"
    return (
        f"(PARTITION BY {layout.key} ORDER BY {SPAN} {direction}"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )


def parts(df: DataFrame, layout: SeriesLayout) -> list[tuple[DataFrame, SeriesLayout]]:
    """Rows of devices that are not cut, with the plain layout, and rows of cut devices.

    Only long devices pay for the extra exchanges of the cut form. Costs a second scan of `df`. The table of long
    devices is a settled one, so Spark knows its size and broadcasts it only if it is small.
    """
    if not layout.is_cut:
        return [(df, layout)]
    return [
        (df.join(layout.long, layout.key, "left_anti"), SeriesLayout(layout.key, layout.time, rows=layout.rows, tasks=layout.tasks)),
        (df.join(layout.long, layout.key, "left_semi"), layout),
    ]


def each_part(
    df: DataFrame, layout: SeriesLayout, operator: Callable[[DataFrame, SeriesLayout], DataFrame]
) -> DataFrame:
    """The operator on each of `parts`, all rows together."""
    results = [operator(rows, own) for rows, own in parts(df, layout)]
    return reduce(lambda a, b: a.unionByName(b), results)


def index_series(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Add the 0-based position of each sample in its device's series and the series length.

    `df` must carry the span column when the layout is cut.
    """
    local = df.withColumn(POSITION, F.row_number().over(layout.ordered()).cast("bigint") - 1)
    if not layout.is_cut:
        whole = Window.partitionBy(*layout.group)
        return local.withColumn(LENGTH, F.count(F.lit(1)).over(whole))
    spans = df.groupBy(*layout.group).agg(F.count(F.lit(1)).alias("_n"))
    offsets = spans.selectExpr(*layout.group, *span_offsets(layout))
    return (
        local.join(offsets, layout.group)
        .withColumn(POSITION, F.col(POSITION) + F.col("_offset"))
        .drop("_offset")
    )


def span_offsets(layout: SeriesLayout) -> list[str]:
    """SQL for the samples before a span and in the whole series, given `_n` samples per span."""
    return [
        f"coalesce(sum(_n) OVER {over_earlier_spans(layout)}, 0) AS _offset",
        f"sum(_n) OVER (PARTITION BY {layout.key}) AS {LENGTH}",
    ]


BLOCK = "_block"
HOME = "_home"


def blocks(
    df: DataFrame, layout: SeriesLayout, before: int, after: int = 0, unit: int = 1,
    block_rows: int = 100_000,
) -> tuple[DataFrame, list[str]]:
    """Regroup indexed samples for moving frames that reach `before` rows back and `after` ahead.

    Uncut layouts need nothing. Otherwise a series is cut by position into blocks of equal length (a
    multiple of `unit`), each with copies of the rows its frames reach into; HOME marks originals.
    Returns the rows and the grouping columns.
    """
    if not layout.is_cut:
        return df.withColumn(HOME, F.lit(True)), [layout.key]
    reach = max(before, after, 1)
    size = -(-max(block_rows, reach) // unit) * unit
    own = F.floor(F.col(POSITION) / size)
    offset = F.col(POSITION) % size
    targets = F.array_compact(
        F.array(
            F.when((offset < after) & (own > 0), own - 1),
            own,
            F.when((offset >= size - before) & ((own + 1) * size < F.col(LENGTH)), own + 1),
        )
    )
    spread = df.withColumn("_own", own).withColumn(BLOCK, F.explode(targets))
    group = [layout.key, BLOCK]
    return (
        spread.withColumn(HOME, F.col(BLOCK) == F.col("_own")).drop("_own").repartition(*group),
        group,
    )
