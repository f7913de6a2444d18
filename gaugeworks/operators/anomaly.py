"""From raw anomaly measures to scores in [0, 1], and exact quantiles of large columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import rescale


def min_max(df: DataFrame, column: str) -> tuple[float, float]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    return low, high


def score_between(df: DataFrame, column: str, low: float, high: float, name: str = "anomaly_score"):
    """Scale a raw measure to [0, 1] between two limits; equal limits give 0 up to them."""
    return df.withColumn(name, rescale(F.col(column), F.lit(low), F.lit(high)))


def min_max_score(
    df: DataFrame, column: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Scale by the batch's own extremes, or by frozen ones to score batches consistently."""
    if low is None or high is None:
        extremes = min_max(df, column)
        if extremes[0] is None:
            return df.withColumn("anomaly_score", F.lit(None).cast("double"))
        low = extremes[0] if low is None else low
        high = extremes[1] if high is None else high
    return score_between(df, column, low, high)


def approximate_quantiles(df: DataFrame, column: str, shares: list[float], accuracy: int = 10_000) -> list[float]:
    """Values whose ranks are within rows / `accuracy` of the wanted ones, in one pass. NaN counts as missing."""
    v = F.col(column).cast("double")
    found = df.agg(F.percentile_approx(F.when(~F.isnan(v), v), shares, accuracy)).first()[0]
    if found is None:
        raise ValueError(f"no values in {column}")
    return found


def quantiles(df: DataFrame, column: str, shares: list[float], sort_rows: int = 100_000) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours, for any number of rows. NaN counts as missing.

    The ranges around all wanted ranks are narrowed together: two values that enclose a rank come from a sketch, the
    values below, at and between them are counted. A range holds a fixed small part of the range before, whatever the
    distribution, until at most `sort_rows` values are left to be sorted. Infinite values are ranks at the ends.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    endless = F.lit(float("inf"))
    count, low, high = values.agg(F.count("v"), F.count_if(v == -endless), F.count_if(v == endless)).first()
    if count == 0:
        raise ValueError(f"no values in {column}")
    ranks = {min(int(s * (count - 1)) + i, count - 1) for s in shares for i in (0, 1)}
    found = {r: float("-inf") for r in ranks if r < low} | {r: float("inf") for r in ranks if r >= count - high}
    inside = [r for r in sorted(ranks) if r not in found]
    found |= _ranked(values, {r: r - low for r in inside}, count - low - high, sort_rows)

    def between(share: float) -> float:
        at = share * (count - 1)
        below = int(at)
        a, b = found[below], found[min(below + 1, count - 1)]
        return a if at == below or a == b else a + (b - a) * (at - below)

    return [between(s) for s in shares]


def _ranked(values: DataFrame, places: dict[int, int], count: int, sort_rows: int, accuracy: int = 10_000) -> dict[int, float]:
    """The finite values at 0-based places; keys of `places` name them."""
    found: dict[int, float] = {}
    # name -> (place within the open range, values in it, its ends)
    ranges = {name: (place, count, float("-inf"), float("inf")) for name, place in places.items()}
    v = F.col("v")
    while wide := [name for name, (_, n, _, _) in ranges.items() if n > sort_rows]:
        sketches = []
        for name in wide:
            place, n, low, high = ranges[name]
            around = [min(max(place / n + d / accuracy, 0.0), 1.0) for d in (-2, 2)]
            own = F.when((v > low) & (v < high), v)
            sketches.append(F.percentile_approx(own, around, accuracy))
        ends = dict(zip(wide, values.agg(*sketches).first(), strict=True))
        counts = []
        for name in wide:
            low, high = ranges[name][2:]
            a, b = ends[name]
            counts += [F.count_if((v > low) & (v < a)), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & F.lit(a < b))]
        table = list(values.agg(*counts).first())
        for i, name in enumerate(wide):
            place, _, low, high = ranges.pop(name)
            a, b = ends[name]
            below, at_a, middle, at_b = table[4 * i : 4 * i + 4]
            if place < below:
                ranges[name] = (place, below, low, a)
            elif place < below + at_a:
                found[name] = a
            elif place < below + at_a + middle:
                ranges[name] = (place - below - at_a, middle, a, b)
            elif place < below + at_a + middle + at_b:
                found[name] = b
            else:
                rest = ranges_count(values, b, high)
                ranges[name] = (place - below - at_a - middle - at_b, rest, b, high)
    if ranges:
        sorted_values = [F.get(F.array_sort(F.collect_list(F.when((v > low) & (v < high), v))), place) for place, _, low, high in ranges.values()]
        found |= dict(zip(ranges, values.agg(*sorted_values).first(), strict=True))
    return found


def ranges_count(values: DataFrame, low: float, high: float) -> int:
    return values.where((F.col("v") > low) & (F.col("v") < high)).count()


def error_score(
    df: DataFrame, column: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Scale errors between their 1st and 99th percentile (or frozen limits)."""
    if low is None or high is None:
        p1, p99 = quantiles(df, column, [0.01, 0.99])
        low = p1 if low is None else low
        high = p99 if high is None else high
    return score_between(df, column, low, high)
