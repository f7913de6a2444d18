"""Shared helpers: tables between steps, word and shingle hashes, connected components."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.store import own_folder
from gaugeworks.tuning import BATCH_SETTING, tune_texts

#: Words everywhere: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


# --- tables between steps ------------------------------------------------------------------------------

def new_folder(spark: SparkSession, name: str) -> str:
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


class _Scratch(threading.local):
    """Folders written since each scratch block that is open in this thread began."""

    def __init__(self):
        self.blocks: list[list[str]] = []


_SCRATCH = _Scratch()


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, lineage cut, columns prunable.

    It goes when the scratch block that it is written in ends (with `keep`, the block around that one), else when the
    driver ends.
    """
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    if len(_SCRATCH.blocks) > keep:
        _SCRATCH.blocks[-1 - keep].append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose tables are deleted at its end. What leaves it must be written with `keep`."""
    _SCRATCH.blocks.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for folder in _SCRATCH.blocks.pop():
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession):
    """A block in which what is executed sends texts as after `tune_texts`; the session's own setting comes back."""
    before = spark.conf.get(BATCH_SETTING)
    tune_texts(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def checked_broadcast(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it has at most `rows`; else joins shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


# --- hashes of words -----------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=np.uint64,
)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Bytes hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (an invertible function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _POWERS[name] = np.cumprod(values, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def give_back() -> None:
    """Arrow keeps memory that is free again, some 50 MB of a worker after a batch of texts; the system gets it back."""
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sliced(column: pa.Array):
    """Slices of a string column of about CHUNK bytes each, in order; a longer text is a slice of its own."""
    _, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield column.slice(first, last - first)
        first = last


def hashed_words(column: pa.Array, lower: bool):
    """Yield (first row, hash of each word, offsets of each row's words) for chunks of whole texts.

    A word's hash is a polynomial in its bytes modulo 2**64, taken from running sums over the chunk, then mixed.
    """
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        n = len(part)
        inside = ~((part == 32) | ((part >= 9) & (part <= 13)))
        opens, closes = inside.copy(), inside.copy()
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        opens[1:] &= ~inside[:-1] | edge[1:n]
        closes[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        yield first, mixed((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, bounds)
        first = last


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words; of all words as one run where there are fewer (none for no words)."""
    n = len(words)
    if not n:
        return words
    steps = np.resize(_STEP, size) + np.arange(size, dtype=np.uint64) // np.uint64(len(_STEP)) * np.uint64(2)
    if n < size:
        return mixed((words * steps[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - size + 1] * steps[0]
    for i in range(1, size):
        total = total + words[i : n - size + 1 + i] * steps[i]
    return mixed(total)


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` words in a row, from running sums; for long runs."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[size:] - total[:-size]) * down[: len(words) - size + 1])


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def bit_map(bits: DataFrame, size: int) -> np.ndarray:
    """`size` bits as 32-bit words, those in column `bit` set. The driver gets size / 8 bytes in blocks."""
    block = 17

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = np.sort(batch.column(0).to_numpy())
            starts = np.flatnonzero(np.r_[True, bit[1:] >> block != bit[:-1] >> block]) if len(bit) else []
            for own in np.split(bit, starts[1:]) if len(bit) else []:
                cells = found.setdefault(int(own[0]) >> block, np.zeros(1 << block, bool))
                cells[own & (1 << block) - 1] = True
        if found:
            packed = [np.packbits(x, bitorder="little").tobytes() for x in found.values()]
            yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(packed, pa.binary())], names=["block", "cells"])

    by_block = bits.repartition(F.shiftright("bit", block)).select("bit")
    rows = by_block.mapInArrow(run, "block long, cells binary").toArrow()
    out = np.zeros(max(size >> 5, 1 << block - 5), np.uint32)
    step = 1 << block - 5
    for at, cells in zip(rows.column("block").to_pylist(), rows.column("cells").to_pylist(), strict=True):
        out[at * step : (at + 1) * step] = np.frombuffer(cells, np.uint32)
    return out


def most_frequent(counts: DataFrame, least: int, most: int) -> DataFrame:
    """Rows of `counts` (n, ...) with the largest n: at least `least`, and a bound above that if they would be over `most`.

    The bound comes from counts of rows by size of n (eight steps for every doubling), so nothing is sorted.
    """
    enough = counts.where(F.col("n") >= least)
    step = F.floor(8 * F.log2("n")).cast("int")
    sizes = sorted(((r["step"], r["rows"]) for r in enough.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, bound = 0, None
    for own, rows in sizes:
        total += rows
        if total > most:
            break
        bound = own
    return enough.where("false") if bound is None else enough.where(step >= bound)


# --- connected components ------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b): its component's smallest node.

    Each round hooks every node to its smallest neighbour and contracts the graph. Only tables in the shared
    folder pass from round to round; rounds grow with the logarithm of the longest chain.
    """
    with scratch(links.sparkSession):
        links = written(links.where("a <> b").select("a", "b").distinct(), "links")
        hooks: list[DataFrame] = []
        while not links.isEmpty():
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
            hook = written(hook.select("node", F.least("node", "low").alias("root")), "hooks")
            hooks.append(hook)
            left, right = hook.toDF("a", "ra"), hook.toDF("b", "rb")
            links = written(
                links.join(left, "a").join(right, "b").where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                "links",
            )
        found = hooks[-1] if hooks else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        for hook in reversed(hooks[:-1]):
            up = found.toDF("root", "top")
            found = hook.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return written(found, "components", keep=True)
