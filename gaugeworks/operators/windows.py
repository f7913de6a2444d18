"""Strided row-count windows: summaries, flattened tensors, supervised sequences, latest window."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.series import BLOCK, HOME, LENGTH, POSITION, SeriesLayout, blocks
from gaugeworks.schema import KEY, TIME, WINDOW_END, WindowSpec, metric_columns

WINDOW_INDEX = "window_index"
VECTOR = "window_values"


def window_table(
    samples: DataFrame,
    layout: SeriesLayout,
    spec: WindowSpec = WindowSpec(),
    statistics: bool = True,
    vector_of: dict[str, Column] | None = None,
    block_rows: int = 100_000,
    latest_only: bool = False,
) -> DataFrame:
    """One row per window of indexed samples (`clean_series`, `index_series`).

    A window starts at every `stride`-th sample of its device and has `size` samples; what is left at
    the end is in no window. Samples are first reduced to panes of gcd(size, stride) rows, so a window
    combines size/gcd panes rather than `size` rows. A window with a missing value has a missing
    statistic: NaN carries that through the aggregates and becomes NULL at the end.

    `vector_of` adds `window_values`, the given expressions per sample, sample by sample. With `latest_only` only
    the samples of each device's last window are aggregated.
    """
    metrics = metric_columns(samples.columns)
    if latest_only:
        start = F.expr(f"({LENGTH} - {spec.size}) DIV {spec.stride} * {spec.stride}")
        samples = samples.where((F.col(LENGTH) >= spec.size) & (F.col(POSITION) >= start) & (F.col(POSITION) < start + spec.size))
    pane_rows = gcd(spec.size, spec.stride)
    per_window, per_stride = spec.size // pane_rows, spec.stride // pane_rows
    rows, group = blocks(
        samples, layout, before=spec.size - pane_rows, unit=pane_rows, block_rows=block_rows
    )
    rows = rows.withColumn("_pane", F.floor(F.col(POSITION) / pane_rows))

    reduced = [
        "count(1) AS _n",
        f"max({layout.time}) AS _end",
        f"max({LENGTH}) AS {LENGTH}",
        f"max({HOME}) AS {HOME}",
    ]
    if statistics:
        for m in metrics:
            value = f"coalesce({m}, double('NaN'))"
            reduced += [
                f"avg({value}) AS _avg_{m}",
                f"var_pop({value}) AS _var_{m}",
                f"max({value}) AS _max_{m}",
            ]
    aggregates = [F.expr(e) for e in reduced]
    if vector_of:
        sample = F.struct(F.col(POSITION).alias("at"), F.array(*vector_of.values()).alias("v"))
        aggregates.append(F.sort_array(F.collect_list(sample)).alias("_samples"))
    panes = rows.groupBy(*group, "_pane").agg(*aggregates)

    frame = (
        f"(PARTITION BY {', '.join(group)} ORDER BY _pane"
        f" ROWS BETWEEN {per_window - 1} PRECEDING AND CURRENT ROW)"
    )
    combined = [layout.key, "_pane", "_end", LENGTH, HOME, f"sum(_n) OVER {frame} AS _rows"]
    if statistics:
        for m in metrics:
            combined += [
                f"avg(_avg_{m}) OVER {frame} AS {m}_mean",
                f"avg(_var_{m}) OVER {frame} + var_pop(_avg_{m}) OVER {frame} AS {m}_var",
                f"max(_max_{m}) OVER {frame} AS {m}_max",
            ]
    if vector_of:
        panes = panes.withColumn("_values", F.expr("flatten(transform(_samples, s -> s.v))"))
        combined.append(f"collect_list(_values) OVER {frame} AS _values")

    chosen = panes.selectExpr(*combined).where(
        f"_rows = {spec.size} AND {HOME} AND (_pane - {per_window - 1}) % {per_stride} = 0"
    )
    out = [
        layout.key,
        f"_end AS {WINDOW_END}",
        f"(_pane - {per_window - 1}) DIV {per_stride} AS {WINDOW_INDEX}",
        f"(_pane - {per_window - 1}) DIV {per_stride}"
        f" = ({LENGTH} - {spec.size}) DIV {spec.stride} AS is_latest",
    ]
    if statistics:
        for m in metrics:
            for name, value in (("mean", f"{m}_mean"), ("std", f"sqrt({m}_var)"), ("max", f"{m}_max")):
                out.append(f"nanvl({value}, NULL) AS {m}_{name}")
    if vector_of:
        out.append(f"flatten(_values) AS {VECTOR}")
    return chosen.selectExpr(*out)


def latest_per_device(df: DataFrame, key: str = KEY, end: str = WINDOW_END) -> DataFrame:
    """The last window of each device. The row-number filter is also applied before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.col(end).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def supervised_sequences(
    samples: DataFrame,
    layout: SeriesLayout,
    inputs: dict[str, Column],
    targets: dict[str, Column],
    lookback: int = 12,
    horizon: int = 6,
    block_rows: int = 100_000,
) -> DataFrame:
    """Pairs of `lookback` input samples and the next `horizon` target samples of indexed samples.

    A pair starts at every max(1, lookback // 2)-th sample. `x` and `y` are flat, sample by sample.
    Steps are grouped like windows: per step, not per sample, a pair is put together.
    """
    if lookback < 1 or horizon < 1:
        raise ValueError("lookback and horizon must be positive")
    step = max(1, lookback // 2)
    ahead = lookback + horizon - 1
    rows, group = blocks(samples, layout, before=0, after=ahead, unit=step, block_rows=block_rows)
    rows = rows.withColumn("_step", F.floor(F.col(POSITION) / step))
    sample = F.struct(
        F.col(POSITION).alias("at"),
        F.col(layout.time).alias("t"),
        F.array(*inputs.values()).alias("x"),
        F.array(*targets.values()).alias("y"),
    )
    steps = rows.groupBy(*group, "_step").agg(
        F.sort_array(F.collect_list(sample)).alias("_samples"),
        F.max(LENGTH).alias(LENGTH),
        F.max(HOME).alias(HOME),
    )
    reach = Window.partitionBy(*group).orderBy("_step").rowsBetween(0, -(-ahead // step))
    joined = steps.select(
        layout.key,
        "_step",
        LENGTH,
        HOME,
        F.flatten(F.collect_list("_samples").over(reach)).alias("_samples"),
    ).where(F.col(HOME) & (F.col("_step") * step + ahead < F.col(LENGTH)))
    seen = F.slice("_samples", 1, lookback)
    future = F.slice("_samples", lookback + 1, horizon)
    return joined.select(
        layout.key,
        F.col("_step").cast("bigint").alias("sequence_index"),
        F.element_at(seen, -1)["t"].alias("cutoff"),
        F.flatten(F.transform(seen, lambda s: s["x"])).alias("x"),
        F.flatten(F.transform(future, lambda s: s["y"])).alias("y"),
    )
