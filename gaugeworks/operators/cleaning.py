"""Cleaning of raw telemetry: keep-last deduplication, gap fill, bound clip, z-score clip."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import clip_to_bounds
from gaugeworks.operators.series import (
    LENGTH,
    POSITION,
    SeriesLayout,
    each_part,
    index_series,
    measure,
    over_earlier_spans,
    parts,
    span_offsets,
)
from gaugeworks.operators.store import settle_grouped
from gaugeworks.schema import KEY, METRICS, SEQ, TIME, metric_columns


def keep_last(
    df: DataFrame, seq: str = SEQ, layout: SeriesLayout | None = None, key: str = KEY, time: str = TIME, apart: str | None = None
) -> DataFrame:
    """One row per device and time: the one that arrived last. Rows without a device are dropped, those that differ in `apart` are no copies.

    Without a layout Spark keeps only the best row per group before the shuffle as well
    (WindowGroupLimit), so any number of copies of one sample costs one row per input partition.
    """
    group = [key, time] if layout is None else list(dict.fromkeys([*layout.group, time]))
    group += [apart] if apart else []
    latest = Window.partitionBy(*group).orderBy(F.col(seq).desc_nulls_last())
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_rank", F.row_number().over(latest))
        .where("_rank = 1")
        .drop("_rank")
    )


def group_samples(df: DataFrame, layout: SeriesLayout, seq: str | None = SEQ, apart: str | None = None) -> DataFrame:
    """Distribute samples by device (by device and span when cut) and drop earlier copies.

    Uncut: one exchange serves the deduplication and everything after it. Cut: copies are reduced
    before and after a first exchange, then samples are dealt to spans.
    """
    df = df.where(F.col(layout.key).isNotNull())
    if not layout.is_cut:
        df = layout.by_group(df)
        return df if seq is None else keep_last(df, seq, layout, layout.key, layout.time, apart)
    if seq is not None:
        df = keep_last(df, seq, None, layout.key, layout.time, apart)
    return layout.attach(df)


def count_missing(df: DataFrame, key: str = KEY) -> DataFrame:
    """Missing metric values per device."""
    missing = sum(
        (F.col(m).isNull().cast("int") for m in metric_columns(df.columns)), start=F.lit(0)
    )
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(missing).cast("bigint").alias("n_missing"))


def count_duplicates(df: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Rows that deduplication removes. Grouping first keeps the distinct keys distributed."""
    return (
        df.groupBy(key, time)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))
    )


def fill_gaps(df: DataFrame, layout: SeriesLayout, metrics: list[str]) -> DataFrame:
    """Linear interpolation by sample position; ends take the nearest valid value.

    `df` is distributed by the layout's group; the result also has position and length.
    """
    indexed = _index_with_neighbours(df, layout, metrics) if layout.is_cut else index_series(df, layout)
    sides = {"p": layout.running(), "q": layout.running(descending=True)}
    seen = indexed
    for side, frame in sides.items():
        seen = seen.selectExpr(
            "*",
            *[f"last({m}, true) OVER {frame} AS _{side}_{m}" for m in metrics],
            *[
                f"last(if({m} IS NULL, NULL, {POSITION}), true) OVER {frame} AS _{side}at_{m}"
                for m in metrics
            ],
        )

    def filled(m: str) -> str:
        p, pat, q, qat = (f"_{name}_{m}" for name in ("p", "pat", "q", "qat"))
        if layout.is_cut:
            p, pat, q, qat = (f"coalesce({c}, _beyond{c})" for c in (p, pat, q, qat))
        line = f"{p} + ({q} - {p}) * try_divide({POSITION} - {pat}, {qat} - {pat})"
        return f"coalesce({m}, {line}, {p}, {q}) AS {m}"

    chosen = set(metrics)
    return seen.selectExpr(
        *[filled(c) if c in chosen else c for c in df.columns], POSITION, LENGTH
    )


def _index_with_neighbours(df: DataFrame, layout: SeriesLayout, metrics: list[str]) -> DataFrame:
    """Position, length and, per metric, the nearest valid value before and after the span."""
    local = df.withColumn(POSITION, F.row_number().over(layout.ordered()).cast("bigint") - 1)
    summary = ["count(1) AS _n"]
    for m in metrics:
        at = f"if({m} IS NULL, NULL, {POSITION})"
        summary += [
            f"max({at}) AS _lastat_{m}",
            f"max_by({m}, {at}) AS _last_{m}",
            f"min({at}) AS _firstat_{m}",
            f"min_by({m}, {at}) AS _first_{m}",
        ]
    before, after = over_earlier_spans(layout), over_earlier_spans(layout, later=True)
    spans = (
        local.groupBy(*layout.group)
        .agg(*[F.expr(e) for e in summary])
        .selectExpr("*", *span_offsets(layout))
    )
    carried = []
    for m in metrics:
        carried += [
            f"last(_last_{m}, true) OVER {before} AS _beyond_p_{m}",
            f"last(_lastat_{m} + _offset, true) OVER {before} AS _beyond_pat_{m}",
            f"last(_first_{m}, true) OVER {after} AS _beyond_q_{m}",
            f"last(_firstat_{m} + _offset, true) OVER {after} AS _beyond_qat_{m}",
        ]
    spans = spans.selectExpr(*layout.group, "_offset", LENGTH, *carried)
    return (
        local.join(spans, layout.group)
        .withColumn(POSITION, F.col(POSITION) + F.col("_offset"))
        .drop("_offset")
    )


def device_moments(df: DataFrame, layout: SeriesLayout, metrics: list[str]) -> DataFrame:
    """`df` with `_mean_*` and `_std_*` (population) of each metric over the whole device."""
    device = f"(PARTITION BY {layout.key})"
    if not layout.is_cut:
        return df.selectExpr(
            "*",
            *[f"avg({m}) OVER {device} AS _mean_{m}" for m in metrics],
            *[f"stddev_pop({m}) OVER {device} AS _std_{m}" for m in metrics],
        )
    summary = [
        f"{function}({m}) AS _{name}_{m}"
        for m in metrics
        for name, function in (("n", "count"), ("avg", "avg"), ("var", "var_pop"))
    ]
    spans = df.groupBy(*layout.group).agg(*[F.expr(e) for e in summary])
    spans = spans.selectExpr(
        "*",
        *[
            f"try_divide(sum(_n_{m} * _avg_{m}) OVER {device}, sum(_n_{m}) OVER {device}) AS _mean_{m}"
            for m in metrics
        ],
    )
    spans = spans.selectExpr(
        *layout.group,
        *[f"_mean_{m}" for m in metrics],
        *[
            f"sqrt(try_divide(sum(_n_{m} * (_var_{m} + pow(_avg_{m} - _mean_{m}, 2))) OVER {device},"
            f" sum(_n_{m}) OVER {device})) AS _std_{m}"
            for m in metrics
        ],
    )
    return df.join(spans, layout.group)


def clip_outliers(
    df: DataFrame, layout: SeriesLayout, metrics: list[str], z_threshold: float = 5.0
) -> DataFrame:
    """Clamp values further than `z_threshold` population deviations from the device's mean.

    A metric with an infinite value on a device has no deviation there (NaN, which Spark puts above all numbers) and
    stays as it is.
    """
    chosen = set(metrics)

    def clamped(m: str) -> str:
        reach = f"{z_threshold}D * _std_{m}"
        return (
            f"CASE WHEN _std_{m} > 0 AND NOT isnan(_std_{m}) AND abs(({m} - _mean_{m}) / _std_{m}) > {z_threshold}D"
            f" THEN least(greatest({m}, _mean_{m} - {reach}), _mean_{m} + {reach}) ELSE {m} END AS {m}"
        )

    measured = device_moments(df, layout, metrics)
    return measured.selectExpr(*[clamped(c) if c in chosen else c for c in df.columns])


def clip_bounds(df: DataFrame) -> DataFrame:
    """Physical limits for every known metric present."""
    present = set(metric_columns(df.columns))
    return df.select(*[clip_to_bounds(c).alias(c) if c in present else F.col(c) for c in df.columns])


def clean_series(
    df: DataFrame, layout: SeriesLayout, z_threshold: float = 5.0, seq: str | None = SEQ
) -> DataFrame:
    """All cleaning steps; keeps position, length and distribution for the operators that follow."""
    metrics = metric_columns(df.columns)
    grouped = group_samples(df, layout, seq)
    return clip_outliers(clip_bounds(fill_gaps(grouped, layout, metrics)), layout, metrics, z_threshold)


def preprocess(
    df: DataFrame, z_threshold: float = 5.0, seq: str | None = SEQ, layout: SeriesLayout | None = None
) -> DataFrame:
    """Raw to clean telemetry, same columns. Pass `seq=None` if samples are known to be unique."""
    def clean(rows: DataFrame, own: SeriesLayout) -> DataFrame:
        return clean_series(rows, own, z_threshold, seq).select(*df.columns)

    return each_part(df, layout or measure(df), clean)


@dataclass(frozen=True)
class Samples:
    """Clean, indexed samples, grouped the way windows need them: one table per part of the layout."""

    tables: tuple[tuple[DataFrame, SeriesLayout], ...]

    def each(self, operator: Callable[[DataFrame, SeriesLayout], DataFrame]) -> DataFrame:
        """Rows that the operator gives for any part."""
        results = [operator(rows, layout) for rows, layout in self.tables]
        return reduce(lambda a, b: a.unionByName(b), results)

    def settled(self) -> "Samples":
        """Computed once; later passes over them need no shuffle by device."""
        return Samples(tuple((settle_grouped(rows, layout.group, layout.time, layout.tasks), layout) for rows, layout in self.tables))

    def clipped(self, z_threshold: float = 5.0) -> "Samples":
        """Outliers by their device's moments: the last step of cleaning."""
        return Samples(tuple((clip_outliers(rows, layout, metric_columns(rows.columns), z_threshold), layout) for rows, layout in self.tables))


def bounded_samples(raw: DataFrame, layout: SeriesLayout | None = None) -> Samples:
    """Last copies, gaps filled, within physical limits: what clipping of outliers and profiles start from. The host is
    not used for windows, so it never enters the shuffle."""
    names = [c for c in (SEQ, TIME, KEY, *METRICS) if c in raw.columns]
    seq = SEQ if SEQ in names else None

    def bounded(rows: DataFrame, own: SeriesLayout) -> DataFrame:
        return clip_bounds(fill_gaps(group_samples(rows, own, seq), own, metric_columns(names))).drop(SEQ)

    found = parts(raw.select(*names), layout or measure(raw))
    return Samples(tuple((bounded(rows, own), own) for rows, own in found))


def clean_samples(raw: DataFrame, layout: SeriesLayout | None = None, z_threshold: float = 5.0) -> Samples:
    """Clean telemetry for windows."""
    return bounded_samples(raw, layout).clipped(z_threshold)
