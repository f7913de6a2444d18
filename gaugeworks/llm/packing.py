"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most `capacity` tokens. How many pieces there are of each length is all that the plan
needs, and that table has at most `capacity` rows however large the corpus is. The plan takes the longest length
that is left and fills its gap exactly with one length, a pair or a triple whose sum is the gap, as often as the
counts allow; where none exists, the longest piece that fits goes in (best fit) and the rest of the gap is tried again.
Every step uses up one length, so the plan has about as many patterns as there are lengths.

Pieces find their places from their rank among the pieces of their length: ranks are counted per task, shifted by
prefix sums over tasks, and looked up in the plan. No task sees all pieces of a length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import small_batches, written
from gaugeworks.llm.tokens import crc, default_tokenizer, encoder


# --- the plan -------------------------------------------------------------------------------------------


def exact_fill(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths that are left and sum to `gap`, the longest first."""
    if left[gap]:
        return (gap,)
    if pair := exact_pair(left, gap, gap - 1):
        return pair
    for first in np.flatnonzero(left[: gap - 1])[::-1].tolist():
        if 3 * first < gap:
            break
        left[first] -= 1
        pair = exact_pair(left, gap - first, first)
        left[first] += 1
        if pair:
            return (first, *pair)
    return None


def exact_pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two lengths of at most `most` that are left and sum to `total`, the longest first."""
    low, high = (total + 1) // 2, min(total - 1, most)
    if high < low:
        return None
    large = left[low : high + 1]
    small = left[total - high : total - low + 1][::-1]
    both = (large > 0) & (small > 0)
    if 2 * low == total:
        both[0] = large[0] > 1
    found = np.flatnonzero(both)
    return (low + int(found[-1]), total - low - int(found[-1])) if len(found) else None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences), using every count up. counts[l]: pieces of length l."""
    left = counts.astype(np.int64).copy()
    out = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            items, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                most = np.flatnonzero(left[: gap + 1])
                if not len(most):
                    break
                fill = exact_fill(left, gap) if gap <= 3 * most[-1] else None
                for length in fill or (int(most[-1]),):
                    items.append(length)
                    left[length] -= 1
                    gap -= length
            uses = Counter(items)
            for length, n in uses.items():
                left[length] += n
            times = min(int(left[length]) // n for length, n in uses.items())
            for length, n in uses.items():
                left[length] -= n * times
            out.append((tuple(items), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Length -> (first ranks, first sequences, offsets) of the runs of ranks that share a pattern's slot."""
    used: Counter[int] = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for items, times in patterns:
        offset = 0
        for length in items:
            runs.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


# --- the operator ---------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, id_column: str, text_column: str, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): `rank` counts the task's pieces of one length."""

    def run(batches):
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            rows, docs = [], batch.column(0).to_pylist()
            for first, ids, offsets in own.encode_column(batch.column(1)):
                ids = memoryview(np.insert(ids, offsets[1:], np.uint32(end_id))).cast("B")
                ended = (offsets + np.arange(len(offsets))).tolist()
                for row, (low, high) in enumerate(zip(ended[:-1], ended[1:], strict=True), first):
                    for piece, at in enumerate(range(low, high, capacity)):
                        length = min(capacity, high - at)
                        rows.append((docs[row], piece, at - low, length, crc(ids[4 * at : 4 * (at + length)]), part, seen[length]))
                        seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """`pieces` (part, rank, length and any others) with sequence_id and offset instead of part and rank."""
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    rows = counts.groupBy("length").agg(F.sum("n").alias("n")).toPandas()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[rows["length"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = pieces.join(shift, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift")
    kept = [c for c in ranked.columns if c != "rank"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length).tolist():
                own = np.flatnonzero(length == value)
                first, sequences, offsets = shared.value[value]
                at = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = sequences[at] + rank[own] - first[at], offsets[at]
            yield pa.record_batch(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    schema = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 0,
    tokenizer: str | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every document lies.

    A document is its text's ids and `end_id`; a null or blank text is `end_id` alone. Documents longer than
    `capacity` are cut into pieces of that length, the last may be shorter. Equal rows and equal or null ids are
    packed like any others; other columns are ignored. `tokenizer` is a file that every worker can read.
    """
    pieces = token_pieces(docs, id_column, text_column, capacity, end_id, tokenizer or default_tokenizer())
    with small_batches(docs.sparkSession):
        placed = written(pieces, "pieces")
    found = packed(placed, capacity)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
