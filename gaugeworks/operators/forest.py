"""Isolation forest (Liu, Ting, Zhou 2008): trees grown in parallel on small samples."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators.vectors import matrices

# Send the functions below to executors themselves: workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = (
    "tree_id int, node_id int, feature int, threshold double, left int, right int, size int, depth int"
)
# Fixed value: Euler's constant to the digits that average path lengths need.
EULER = 0.5772156649015329


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def grow_tree(points: np.ndarray, max_depth: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node_id, feature, threshold, left, right, size, depth); leaves have feature -1."""
    nodes: list[tuple] = []
    waiting = [(0, points, 0)]
    used = 1
    while waiting:
        node, inside, depth = waiting.pop()
        low, high = inside.min(axis=0), inside.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= max_depth or len(inside) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, -1, -1, len(inside), depth))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = inside[:, feature] <= threshold
        if goes_left.all():  # the draw hit the maximum
            goes_left = inside[:, feature] < high[feature]
        left, right = used, used + 1
        used += 2
        nodes.append((node, feature, threshold, left, right, len(inside), depth))
        waiting += [(left, inside[goes_left], depth + 1), (right, inside[~goes_left], depth + 1)]
    return nodes


def raw_scores(points: np.ndarray, forest: dict) -> np.ndarray:
    """2^(-mean path / average path of the sample): near 1 is anomalous."""
    feature, threshold = forest["feature"], forest["threshold"]
    left, right, path = forest["left"], forest["right"], forest["path"]
    rows = np.arange(len(points))
    depth = np.zeros(len(points))
    for tree in range(feature.shape[0]):
        node = np.zeros(len(points), dtype="int32")
        for _ in range(max_depth(forest["sample_size"])):
            goes_left = points[rows, feature[tree][node]] <= threshold[tree][node]
            node = np.where(goes_left, left[tree][node], right[tree][node])
        depth += path[tree][node]
    mean = depth / feature.shape[0]
    return np.power(2.0, -mean / max(float(average_path(forest["sample_size"])), 1e-12))


@dataclass(frozen=True)
class IsolationForest:
    """Node table as arrays [tree, node]; at most trees x (2 x sample - 1) nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    sample_size: int
    cutoff: float | None = None

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, sample_size: int, cutoff: float | None = None):
        trees, width = int(nodes["tree_id"].max()) + 1, int(nodes["node_id"].max()) + 1
        at = (nodes["tree_id"].to_numpy(), nodes["node_id"].to_numpy())

        def table(values, dtype):
            out = np.zeros((trees, width), dtype=dtype)
            out[at] = values
            return out

        leaf = nodes["feature"].to_numpy() < 0
        own = nodes["node_id"].to_numpy()
        return IsolationForest(
            table(np.where(leaf, 0, nodes["feature"]), "int32"),
            table(nodes["threshold"], "float64"),
            table(np.where(leaf, own, nodes["left"]), "int32"),  # a leaf leads to itself
            table(np.where(leaf, own, nodes["right"]), "int32"),
            table(nodes["depth"] + np.where(leaf, average_path(nodes["size"]), 0.0), "float64"),
            sample_size,
            cutoff,
        )

    def tables(self) -> dict:
        names = ("feature", "threshold", "left", "right", "path", "sample_size")
        return {name: getattr(self, name) for name in names}

    def score(self, spark: SparkSession, embedding: str | Column) -> Column:
        """Raw score of an array column; the model travels as one broadcast variable."""
        model = spark.sparkContext.broadcast(self.tables())

        @F.arrow_udf("double")
        def raw(points: pa.Array) -> pa.Array:
            out = np.full(len(points), np.nan)
            for rows, some in matrices(points):
                out[rows] = raw_scores(some, model.value)
            return pa.array(out)

        return F.nanvl(raw(embedding), F.lit(None).cast("double"))

    def is_anomaly(self, raw: Column) -> Column:
        if self.cutoff is None:
            raise ValueError("the forest was fitted without a contamination share")
        return raw > self.cutoff

    def save(self, spark: SparkSession, path: str, mode: str = "error") -> None:
        trees, width = self.feature.shape
        tree, node = (a.ravel() for a in np.indices((trees, width)))
        table = pd.DataFrame(
            {
                "tree_id": tree,
                "node_id": node,
                **{n: getattr(self, n).ravel() for n in ("feature", "threshold", "left", "right", "path")},
            }
        )
        table["sample_size"] = self.sample_size
        table["cutoff"] = float("nan") if self.cutoff is None else self.cutoff
        spark.createDataFrame(table).coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        t = spark.read.parquet(path).toPandas().sort_values(["tree_id", "node_id"])
        shape = (int(t["tree_id"].max()) + 1, int(t["node_id"].max()) + 1)
        cutoff = float(t["cutoff"].iloc[0])
        return IsolationForest(
            *[t[n].to_numpy().reshape(shape) for n in ("feature", "threshold", "left", "right", "path")],
            int(t["sample_size"].iloc[0]),
            None if np.isnan(cutoff) else cutoff,
        )


def max_depth(sample_size: int) -> int:
    return max(1, ceil(np.log2(max(sample_size, 2))))


def tree_samples(
    df: DataFrame, embedding: str, keys: list[str], trees: int, sample_size: int, seed: int
) -> tuple[DataFrame, int]:
    """`sample_size` distinct rows per tree as (tree_id, embedding), chosen by hash of the row's key, by the same rule for
    any number of rows.

    A pool of trees x sample_size rows is enough. It is dealt out like cards: a shuffle of the pool
    serves as many trees as it has whole hands, the next shuffle serves the next trees.
    """
    known = df.where(F.col(embedding).isNotNull()).select(*keys, F.col(embedding).alias("v"))
    rows = known.count()
    if rows == 0:
        raise ValueError("cannot fit a forest on no rows")
    pool_rows = min(rows, trees * sample_size)

    def position(salt: Column) -> Column:
        return F.xxhash64(*keys, F.lit(seed), salt)

    # The pool is the rows with the smallest hashes. Rows beyond a bound that about twice the pool stays below need not be
    # sorted; the count makes sure that the pool is among those that stay.
    known = known.withColumn("_at", F.pmod(position(F.lit(-1)), F.lit(2**40)))
    low = known.where(F.col("_at") <= int(2 * pool_rows / rows * 2**40))
    pool = (low if low.count() >= pool_rows else known).orderBy("_at", *keys).limit(pool_rows)
    hand = min(sample_size, pool_rows)
    hands = pool_rows // hand
    deals = -(-trees // hands)
    dealt = pool.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    shuffled = Window.partitionBy("_deal").orderBy(position(F.col("_deal")), *keys)
    number = F.row_number().over(shuffled) - 1
    samples = (
        dealt.withColumn("_number", number)
        .withColumn("tree_id", (F.col("_deal") * hands + F.floor(F.col("_number") / hand)).cast("int"))
        .where((F.col("_number") < hands * hand) & (F.col("tree_id") < trees))
        .select("tree_id", F.col("v").alias("embedding"))
    )
    return samples, hand


def fit_forest_nodes(
    df: DataFrame, embedding: str, keys: list[str], trees: int, sample_size: int, seed: int
) -> tuple[DataFrame, int]:
    """Node table of the forest and the sample size actually used."""
    samples, hand = tree_samples(df, embedding, keys, trees, sample_size, seed)
    depth = max_depth(hand)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree_id"].iloc[0])
        points = np.stack(rows["embedding"].to_numpy()).astype("float64")
        points = points[np.lexsort(points.T)]  # independent of the order rows arrive in
        nodes = grow_tree(points, depth, np.random.default_rng([seed, tree]))
        columns = ["node_id", "feature", "threshold", "left", "right", "size", "depth"]
        out = pd.DataFrame(nodes, columns=columns)
        out.insert(0, "tree_id", tree)
        return out

    return samples.groupBy("tree_id").applyInPandas(grow, NODES), hand


def fit_forest(
    df: DataFrame,
    embedding: str,
    keys: list[str],
    trees: int = 200,
    sample_size: int = 256,
    seed: int = 42,
    contamination: float | None = 0.03,
) -> IsolationForest:
    """Fit on an array column; `keys` identify rows and drive the sampling.

    With a contamination share the cutoff is the raw score that this share of the rows exceeds.
    """
    from gaugeworks.operators.anomaly import quantiles
    from gaugeworks.operators.store import settle

    nodes, hand = fit_forest_nodes(df, embedding, keys, trees, sample_size, seed)
    forest = IsolationForest.from_nodes(nodes.toPandas(), hand)
    if contamination is None:
        return forest
    raw = settle(df.select(forest.score(df.sparkSession, F.col(embedding)).alias("raw")))
    cutoff = quantiles(raw, "raw", [1.0 - contamination])[0]
    return IsolationForest(**{**forest.__dict__, "cutoff": cutoff})
