"""Hard-negative mining with bounds from spanning trees of anchors.

Scores are inner products of vectors of integers. Anchors are asked for their best positives (rows of the same label),
and then, for each positive, for the best rows of other labels whose score lies in a window under the positive's. The steps:

1. Candidates are packed into blocks of rows, anchors into groups; neither depends on keys, so no key can be hot. A group
   holds anchors of neighbouring labels and vectors, and its minimum spanning tree by Euclidean distance.
2. Every group meets every block (the anchors are the stated query set), dealt to tasks by group and shard of blocks.
3. In a task, the root's scores are computed for all rows of a block. A child's score differs from its parent's by at most
   the edge's length times the row's norm, which bounds it from both sides. Only rows of the wanted labels whose bounds
   reach into a window, above the worst of its best rows so far, are scored; for the others the bounds pass on to the
   child's children, widened by the next edge.
4. A task returns the best rows of each window in its shard; the best of all shards are taken by Spark.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import scratch, written

#: Scores up to this size are exact in double arithmetic.
EXACT = float(1 << 52)
PACKED = "id binary, label binary, vector binary, dim long, kind string, rows long"


# --- vectors -------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, id_column: str, label: Column, vector_column: str, scale: int) -> DataFrame:
    """(id, label, vector): floor(scale * x) of every component, as long; rows that name nothing or have no number left out.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Of rows with one id, the
    smallest (label, vector) counts.
    """
    numbers = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.forall("numbers", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), numbers.alias("numbers"))
    found = found.where("id IS NOT NULL AND label IS NOT NULL AND numbers IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    found = found.select("id", "label", F.transform("numbers", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vector"))
    best = found.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("best"))
    return best.select("id", "best.label", "best.vector")


def packed(ids, labels, vectors: pa.Array) -> list:
    """One row of binary columns; vectors in the narrowest integers that hold them, shorter ones filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy().astype(np.int64)
    dim = int(lengths.max(initial=0))
    flat = vectors.flatten().to_numpy()
    matrix = np.zeros((len(lengths), dim), np.int64)
    matrix[np.arange(dim)[None, :] < lengths[:, None]] = flat
    low, high = (int(flat.min()), int(flat.max())) if len(flat) else (0, 0)
    kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return [ids.tobytes(), labels.tobytes(), matrix.astype("<" + kind).tobytes(), dim, kind, len(lengths)]


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    matrix = np.frombuffer(row["vector"], "<" + row["kind"]).reshape(row["rows"], row["dim"])
    return np.frombuffer(row["id"], np.int64), np.frombuffer(row["label"], np.int64), matrix


def blocks_of(vectors: DataFrame, size: int, shards: int) -> DataFrame:
    """Candidates, `size` rows in a row; `shard` deals the blocks out."""

    def run(batches):
        made = 0
        for batch in batches:
            for at in range(0, len(batch), size):
                own = batch.slice(at, size)
                row = packed(own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(2))
                shard = (TaskContext.get().partitionId() * 7 + made) % shards
                made += 1
                yield pa.record_batch([pa.array([x]) for x in [shard, *row]], names=["shard", "id", "label", "vector", "dim", "kind", "rows"])

    return vectors.select("id", "label", "vector").mapInArrow(run, f"shard long, {PACKED}")


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent of each point or -1, distance to it) of the minimum spanning tree; parents come before children."""
    n = len(points)
    squares = (points * points).sum(axis=1)
    near, parent, inside = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, edge = np.zeros(n, np.int64), np.zeros(n)
    near[0] = 0
    for step in range(n):
        at = int(np.argmin(np.where(inside, np.inf, near)))
        order[step], inside[at] = at, True
        if parent[at] >= 0:
            edge[at] = np.sqrt(((points[at] - points[parent[at]]) ** 2).sum())
        away = squares + squares[at] - 2 * (points @ points[at])
        closer = ~inside & (away < near)
        near[closer], parent[closer] = away[closer], at
    return order, parent, edge


def groups_of(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors (id, label, vector, windows) as groups of about `size`, in order of label; `part` numbers ranges of groups.

    `windows` is a list of (low, high) scores, packed as `spans` with `taken`, the number of each anchor's windows.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), size):
                own = batch.slice(at, size)
                row = packed(own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(2))
                windows = own.column(3)
                taken = windows.value_lengths().to_numpy().astype(np.int64)
                flat = windows.flatten()
                spans = np.stack([flat.field(k).to_numpy() for k in range(2)], axis=1).astype(np.int64)
                row += [spans.tobytes(), taken.tobytes()]
                yield pa.record_batch([pa.array([x]) for x in [part, *row]], names=["part", "id", "label", "vector", "dim", "kind", "rows", "spans", "taken"])

    number = max(1, -(-anchors.count() // size))
    ranged = anchors.repartitionByRange(number, "label", "vector", "id").sortWithinPartitions("label", "vector", "id")
    return ranged.select("id", "label", "vector", "windows").mapInArrow(run, f"part long, {PACKED}, spans binary, taken binary")


# --- the search ----------------------------------------------------------------------------------------


class Search:
    """The best rows of each window of each anchor of a group, over the blocks shown to it."""

    def __init__(self, group: dict, same: bool, most: int):
        self.ids, self.labels, self.vectors = unpacked(group)
        self.same, self.most = same, most
        points = self.vectors.astype(np.float64)
        self.points, self.largest = points, float(np.abs(points).max(initial=0))
        self.order, self.parent, self.edge = spanning_tree(points)
        taken = np.frombuffer(group["taken"], np.int64)
        cuts = np.concatenate(([0], np.cumsum(taken)))
        spans = np.frombuffer(group["spans"], np.int64).reshape(-1, 2)
        self.spans = [spans[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own] for own in self.spans]
        #: Rows scored, and rows met, for the measure of what the bounds save.
        self.scored = self.met = 0

    def show(self, block: dict) -> None:
        ids, labels, vectors = unpacked(block)
        dim = min(vectors.shape[1], self.points.shape[1])  # missing components are zero
        rows = vectors[:, :dim].astype(np.float64)
        anchors = self.points[:, :dim]
        exact = dim * self.largest * float(np.abs(rows).max(initial=0)) < EXACT
        if not exact:  # beyond doubles: Python's whole numbers
            rows, anchors = vectors[:, :dim].astype(object), self.vectors[:, :dim].astype(object)
        norms = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        low, high = np.zeros((len(anchors), len(rows))), np.zeros((len(anchors), len(rows)))
        for k in self.order:
            spans = self.spans[k]
            p = self.parent[k]
            if p < 0:
                wanted = np.ones(len(rows), bool)  # the root's scores bound the others
            else:
                slack = self.edge[k] * (1 + 1e-9) * norms + 1e-6 * (1 + np.abs(low[p]))
                low[k], high[k] = low[p] - slack, high[p] + slack
                if not len(spans):
                    continue
                floors = [float(s[0]) if len(b[0]) < self.most else float(max(s[0], b[0][-1])) for s, b in zip(spans, self.best[k], strict=True)]
                wanted = (labels == self.labels[k]) == self.same
                wanted &= (high[k] >= min(floors)) & (low[k] <= float(spans[:, 1].max()))
            at = np.flatnonzero(wanted)
            self.scored += len(at)
            self.met += len(rows)
            if not len(at):
                continue
            scores = rows[at] @ anchors[k] if len(at) < len(rows) else rows @ anchors[k]
            low[k, at] = high[k, at] = scores.astype(np.float64)
            if len(spans):
                if p < 0:
                    fit = (labels[at] == self.labels[k]) == self.same
                    at, scores = at[fit], scores[fit]
                # Scores over 64 bits count as the nearest that fit.
                whole = scores.astype(np.int64) if exact else np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in scores], np.int64)
                self.keep(k, ids[at], whole)

    def keep(self, k: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.same:
            other = ids != self.ids[k]
            ids, scores = ids[other], scores[other]
        for w, (least, greatest) in enumerate(self.spans[k]):
            old_scores, old_ids = self.best[k][w]
            inside = (scores >= (max(least, old_scores[-1]) if len(old_scores) == self.most else least)) & (scores <= greatest)
            if not inside.any():
                continue
            own_scores, own_ids = np.concatenate((old_scores, scores[inside])), np.concatenate((old_ids, ids[inside]))
            if len(own_scores) > 4 * self.most:
                worst = np.partition(own_scores, len(own_scores) - self.most)[len(own_scores) - self.most]
                own_scores, own_ids = own_scores[own_scores >= worst], own_ids[own_scores >= worst]
            order = np.lexsort((own_ids, -own_scores))[: self.most]
            self.best[k][w] = own_scores[order], own_ids[order]

    def found(self) -> pa.RecordBatch:
        rows = [(i, w, x, s) for i, own in zip(self.ids.tolist(), self.best, strict=True) for w, (scores, ids) in enumerate(own) for x, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["anchor", "window", "id", "score"])


def searched(blocks: DataFrame, groups: DataFrame, same: bool, most: int) -> DataFrame:
    """(anchor, window, id, score): the `most` best rows of every window, among rows of the anchor's label or of others."""
    columns = ["id", "label", "vector", "dim", "kind", "rows"]
    parts = groups.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    asked = groups.select("part", F.struct(*columns, "spans", "taken").alias("group"), F.monotonically_increasing_id().alias("number"))
    shown = blocks.select("shard", F.struct(*columns).alias("block"), F.explode(F.expr(f"sequence(0L, {parts}L)")).alias("part"))

    def run(batches):
        search, at = None, None
        for batch in batches:
            numbers, shards = batch.column("number").to_pylist(), batch.column("shard").to_pylist()
            for i in range(len(batch)):
                if at != (numbers[i], shards[i]):
                    if search is not None:
                        yield search.found()
                    search, at = Search(batch.column("group")[i].as_py(), same, most), (numbers[i], shards[i])
                search.show(batch.column("block")[i].as_py())
        if search is not None:
            yield search.found()

    met = shown.join(asked, "part").repartition("number", "shard").sortWithinPartitions("number", "shard")
    found = met.mapInArrow(run, "anchor long, window int, id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: Column | str = "label", vector_column: str = "embedding",
    positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: int = 256, block: int = 8192, group: int = 256, shards: int = 64,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows with `is_anchor` (a
    condition on `id`).

    Components become floor(scale * x); a score is the inner product with the anchor, missing components counting as zero.
    An anchor's positives are its first `positives` other rows of its label, by score, ties by the smaller id; all, if
    there are fewer. For each, the first `negatives` rows of other labels with least_percent % of its score <= score <= its
    score come back, ranked from 1. Anchors without positives and positives without such rows give none.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; of rows with one id the smallest
    (label, vector) counts; other columns are ignored. `block`, `group` and `shards` (rows of a block, anchors of a group,
    parts of the blocks) steer the work, not the result.
    """
    with scratch(rows.sparkSession):
        label = F.col(label) if isinstance(label, str) else label
        vectors = written(whole_vectors(rows, id_column, label, vector_column, scale), "vectors")
        blocks = written(blocks_of(vectors, block, shards), "blocks")
        anchors = written(vectors.where(is_anchor), "anchors")
        everything = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
        near = written(searched(blocks, written(groups_of(anchors.withColumn("windows", everything), group), "groups"), True, positives), "positives")

        # least <= score <= greatest, in whole numbers; empty for a negative score.
        least = F.expr(f"CAST((CAST(score AS decimal(38, 0)) * {least_percent} + 99) div 100 AS long)")
        ordered = near.where("score >= 0").groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", least.alias("low"), F.col("score").alias("high"), F.col("id").alias("positive_id")))).alias("own"))
        windows = F.transform("own", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))
        asking = anchors.join(ordered.select(F.col("anchor").alias("id"), windows.alias("windows")), "id")
        found = searched(blocks, written(groups_of(asking, group), "asking"), False, negatives)
        named = ordered.select("anchor", F.posexplode("own").alias("window", "p")).select("anchor", "window", F.col("p.positive_id").alias("positive_id"), F.col("p.high").alias("positive_score"))
        out = found.join(named, ["anchor", "window"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        return written(out, "hard_negatives", keep=True)
