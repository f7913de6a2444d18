"""Token ids in ORC files, in ascending order of document ids.

ORC stores integers run-length encoded in stripes; stripes are read in parallel. Row indexes (smallest and largest id
of every `stride` rows) and Bloom filters on document ids let a lookup skip files, stripes and row groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import small_batches, written
from gaugeworks.llm.tokens import crc, default_tokenizer, encoder

SCHEMA = "doc_id long, part int, ids array<int>"


def token_rows(docs: DataFrame, id_column: str, text_column: str, end_id: int, tokenizer: str) -> DataFrame:
    """(doc_id, part, ids) in ascending order of ids; `part` numbers the ranges of ids, one for each file."""

    def run(batches):
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        for batch in batches:
            for first, ids, offsets in own.encode_column(batch.column(1)):
                rows = len(offsets) - 1
                values = pa.array(np.insert(ids, offsets[1:], np.uint32(end_id)).view(np.int32))
                ended = (offsets + np.arange(rows + 1)).astype(np.int32)
                columns = [batch.column(0).slice(first, rows), pa.array(np.full(rows, part, np.int32)), pa.ListArray.from_arrays(ended, values)]
                yield pa.record_batch(columns, names=["doc_id", "part", "ids"])

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # Equal ids may be many: the texts' hashes let them spread over files.
    ordered = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame, folder: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1,
    tokenizer: str | None = None, stripe_bytes: int = 64 << 20, stride: int = 1000, false_positives: float = 0.01,
) -> None:
    """Write every text's ids and `end_id` as ORC, one row for each row of `docs`.

    Null and blank texts have `end_id` alone; null ids come first; equal rows are kept; other columns are ignored.
    """
    rows = token_rows(docs, id_column, text_column, end_id, tokenizer or default_tokenizer())
    with small_batches(docs.sparkSession):
        (
            rows.write.mode("errorifexists")
            .option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", stride)
            .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", false_positives).orc(folder)
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, ids). A filter on doc_id is pushed into the files."""
    return spark.read.schema(SCHEMA).orc(folder)


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows read back: `start` counts the ids of all rows before.

    Rows are in order of doc_id (equal ids in any one order). The sums are taken within each file's range of ids and
    shifted by the totals of the ranges before it, of which there are as many as files.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = ids.flatten().to_numpy().astype("<u4", copy=False)
            offsets = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))).astype(np.int64)
            data = memoryview(np.ascontiguousarray(values)).cast("B")
            sums = [crc(data[a:b]) for a, b in zip((4 * offsets[:-1]).tolist(), (4 * offsets[1:]).tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("part"), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "n_tokens", "ids_crc32"],
            )

    with small_batches(tokens.sparkSession):
        found = written(tokens.mapInArrow(run, "doc_id long, part int, n_tokens long, ids_crc32 long"), "digests")
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("part").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    within = found.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return within.join(shifts, "part").select("doc_id", (F.col("start") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32")
