"""Which embedding dimensions drive the anomaly score: exact Shapley values of its trees, or sampled ones of the score."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.numeric import round_to
from gaugeworks.operators.forest import IsolationForest, average_path, raw_scores

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _hash_top(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


# --- exact values --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaf:
    """A leaf's box (low < x <= high in each of its dimensions), its share of the mean path, and how many background rows
    meet each set of the box's sides (a bit for each dimension)."""

    dimensions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: float
    sides: np.ndarray
    rows: np.ndarray


def boxes(forest: IsolationForest) -> list[tuple[dict[int, tuple[float, float]], float]]:
    """Every leaf as ({dimension: (low, high)}, path), trees one after the other."""
    found = []
    for tree in range(forest.feature.shape[0]):
        waiting: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
        while waiting:
            node, box = waiting.pop()
            left, right = int(forest.left[tree, node]), int(forest.right[tree, node])
            if left == node:
                found.append((box, float(forest.path[tree, node])))
                continue
            dimension, cut = int(forest.feature[tree, node]), float(forest.threshold[tree, node])
            low, high = box.get(dimension, (-np.inf, np.inf))
            waiting.append((left, {**box, dimension: (low, min(high, cut))}))
            waiting.append((right, {**box, dimension: (max(low, cut), high)}))
    return found


def sides_met(points: np.ndarray, dimensions: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For every point the set of dimensions in which it lies in the box, as bits."""
    own = points[:, dimensions]
    return ((own > low) & (own <= high)) @ (1 << np.arange(len(dimensions), dtype=np.int64))


def leaves(forest: IsolationForest, background: np.ndarray) -> list[Leaf]:
    found = []
    scale = -1.0 / forest.feature.shape[0] / max(float(average_path(forest.sample_size)), 1e-12)
    for box, path in boxes(forest):
        if not box:
            continue  # a tree that is one leaf tells rows apart by nothing
        dimensions = np.array(sorted(box))
        low, high = (np.array([box[d][k] for d in dimensions]) for k in range(2))
        sides, rows = np.unique(sides_met(background, dimensions, low, high), return_counts=True)
        found.append(Leaf(dimensions, low, high, scale * path, sides, rows / len(background)))
    return found


def contributions(points: np.ndarray, model: list[Leaf]) -> np.ndarray:
    """Shapley values [row, dimension] of log2(raw score) against the background.

    A leaf is reached by a mixture of row and background row if every side of its box is met by the one that gives the
    dimension. So it is a product of conditions: n dimensions must come from the row, m from the background row, the
    others are met by both. The Shapley values of such a product are (n-1)! m! / (n+m)! for the former and
    -n! (m-1)! / (n+m)! for the latter. They depend on the sides met only, so equal rows share the work.
    """
    most = max((len(leaf.dimensions) for leaf in model), default=0)
    gain, loss = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    for n in range(most + 1):
        for m in range(most + 1 - n):
            gain[n, m] = factorial(n - 1) * factorial(m) / factorial(n + m) if n else 0.0
            loss[n, m] = factorial(n) * factorial(m - 1) / factorial(n + m) if m else 0.0
    out = np.zeros(points.shape)
    for leaf in model:
        every = (1 << len(leaf.dimensions)) - 1
        sides, which = np.unique(sides_met(points, leaf.dimensions, leaf.low, leaf.high), return_inverse=True)
        one, other = sides[:, None], leaf.sides[None, :]
        weight = np.where((one | other) == every, leaf.rows * leaf.value, 0.0)
        asked, against = one & ~other, other & ~one
        n, m = np.bitwise_count(asked), np.bitwise_count(against)
        plus, minus = weight * gain[n, m], weight * loss[n, m]
        bits = np.arange(len(leaf.dimensions))
        table = np.einsum("rb,rbk->rk", plus, asked[:, :, None] >> bits & 1) - np.einsum("rb,rbk->rk", minus, against[:, :, None] >> bits & 1)
        out[:, leaf.dimensions] += table[which]
    return out


def background_sample(df: DataFrame, embedding: str, keys: list[str], rows: int, seed: int = 42) -> DataFrame:
    """The `rows` rows with the smallest MD5 hashes of their keys and the seed; a rule that other engines have as well."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    known = df.where(F.col(embedding).isNotNull()).select(*keys, embedding)
    return known.orderBy(F.md5(text.cast("binary")), *keys).limit(rows)


def exact_shapley_values(
    df: DataFrame, embedding: str, keys: list[str], forest: IsolationForest, dimensions: int, background_rows: int = 100, seed: int = 42,
) -> DataFrame:
    """One row per (key, dimension) with its exact contribution `phi` to log2 of the raw score, without sampling.

    The raw score is 2^(-mean path / average path), so its logarithm is a sum over leaves, for which Shapley values have a
    closed form. `phi` of a row add up to log2(score) less the background rows' mean of it; larger is more anomalous.
    The background are `background_rows` rows drawn by hash; they are all that the driver collects. Rows without an
    embedding come back with null `phi`. Nothing is shuffled.
    """
    chosen = background_sample(df, embedding, keys, background_rows, seed).collect()
    if not chosen:
        raise ValueError("no background rows")
    background = np.array([row[embedding] for row in chosen], dtype="float64")
    model = df.sparkSession.sparkContext.broadcast(leaves(forest, background))

    def run(batches):
        for batch in batches:
            column = batch.column(len(keys))
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            phi = np.full((len(batch), dimensions), np.nan)
            if len(known):
                points = column.drop_null().flatten().to_numpy().reshape(len(known), dimensions)
                phi[known] = contributions(points, model.value)
            rows = pa.array(np.repeat(np.arange(len(batch)), dimensions))
            columns = [batch.column(i).take(rows) for i in range(len(keys))]
            number = pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(batch)))
            yield pa.record_batch([*columns, number, pa.array(phi.ravel(), from_pandas=True)], names=[*keys, "dimension", "phi"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    return df.select(*keys, F.col(embedding).cast("array<double>")).mapInArrow(run, f"{schema}, dimension int, phi double")


# --- sampled values ------------------------------------------------------------------------------------


def shapley_values(
    df: DataFrame,
    embedding: str,
    keys: list[str],
    forest: IsolationForest,
    dimensions: int,
    background_rows: int = 100,
    permutations: int = 8,
    seed: int = 42,
) -> DataFrame:
    """One row per (key, dimension) with its contribution `phi` to the raw score.

    Per row and permutation a background row turns into the row one dimension at a time, in the
    permutation's order; a dimension's contribution is the step it causes. The steps of a permutation
    add up to score(row) - score(background row). At most `background_rows` vectors are collected. Nothing is shuffled:
    a row's points are scored as one array.
    """
    spark = df.sparkSession
    chosen = _hash_top(df.select(*keys, embedding), keys, background_rows, seed).collect()
    background = F.array(*[F.array(*[F.lit(float(x)) for x in row[embedding]]) for row in chosen])
    steps, dims = F.sequence(F.lit(0), F.lit(dimensions)), F.sequence(F.lit(0), F.lit(dimensions - 1))

    def path(p: Column) -> Column:
        """A permutation: for every dimension the step at which it is taken from the row, and the background row."""
        drawn = F.array_sort(F.transform(dims, lambda d: F.struct(F.xxhash64(*keys, p, d, F.lit(seed)).alias("h"), d.alias("d"))))
        order = F.transform(drawn, lambda s: s["d"])
        other = F.pmod(F.xxhash64(*keys, p, F.lit(seed + 1)), F.lit(len(chosen)))
        return F.struct(F.transform(dims, lambda d: F.array_position(order, d).cast("int")).alias("turn"), F.element_at(background, (other + 1).cast("int")).alias("other"))

    def mixed(x: Column, step: Column) -> Column:
        return F.transform(dims, lambda d: F.when(F.get(x["turn"], d) <= step, F.get("own", d).cast("double")).otherwise(F.get(x["other"], d)))

    paths = df.select(*keys, F.col(embedding).alias("own")).withColumn(
        "paths", F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), path)
    )
    points = F.flatten(F.transform("paths", lambda x: F.transform(steps, lambda step: mixed(x, step))))
    model = spark.sparkContext.broadcast(forest.tables())

    def steps_of(batches):
        """What a dimension adds in a permutation: the score at its step less the one before; the mean over permutations."""
        for batch in batches:
            if not len(batch):
                continue
            raw = raw_scores(np.stack([np.stack(p) for p in batch["points"]]).reshape(-1, dimensions).astype("float64"), model.value)
            raw = raw.reshape(len(batch), permutations, dimensions + 1)
            turn = np.stack([np.stack(t) for t in batch["turns"]]).astype("int64")
            added = (np.take_along_axis(raw, turn, 2) - np.take_along_axis(raw, turn - 1, 2)).mean(axis=1)
            out = batch[keys].loc[batch.index.repeat(dimensions)].reset_index(drop=True)
            yield out.assign(dimension=np.tile(np.arange(dimensions, dtype="int32"), len(batch)), phi=added.ravel())

    rows = paths.select(*keys, points.alias("points"), F.transform("paths", lambda x: x["turn"]).alias("turns"))
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    return rows.mapInPandas(steps_of, f"{schema}, dimension int, phi double")


def importance(values: DataFrame) -> DataFrame:
    """Mean absolute contribution per dimension, largest first."""
    return (
        values.groupBy("dimension")
        .agg(F.avg(F.abs("phi")).alias("m"))
        .select(
            F.concat(F.lit("latent_"), F.col("dimension").cast("string")).alias("feature"),
            round_to(F.col("m"), 5).alias("mean_abs_shap"),
        )
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )
