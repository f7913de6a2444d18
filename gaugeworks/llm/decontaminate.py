"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. Windows are as long as an item and may start anywhere. One that reaches the threshold holds at least threshold x length
   shingles (runs of `size` words) of the item, in any order, so documents are searched for stretches of an item's
   length with so many hits. Of equally good windows the first one ends with a hit or begins with the document: these
   are the windows that count.
2. Windows get a 64-bit SimHash, weighted by how often a shingle occurs in the window.
3. An item comes into question for a window if they share one of the item's rarest shingles, of which a similar window
   cannot lack all (prefix filter).
4. Multi-index Hamming: fingerprints are cut into blocks. If two fingerprints differ in at most `radius` bits, some
   block differs in at most radius / blocks of its bits; items are indexed under all such block values, windows look up
   their own. So every pair within the radius is found, by equal keys alone.
5. Found pairs are verified by the exact similarity of their shingles with multiplicities: the sum of the smaller counts
   over the sum of the larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import checked_broadcast, written

TOKEN = r"[\p{L}\p{N}]+"
BLOCKS, BLOCK_BITS = 8, 8


def shingles(text: Column, size: int) -> Column:
    """Hashes of the runs of `size` words (letters and digits, lower case), in order; empty for fewer words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    # Bound once as a lambda's argument, so that the words are not split anew for every shingle.
    runs = F.transform(
        F.array(words),
        lambda w: F.transform(
            F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]),
        ),
    )
    return F.get(runs, 0)


def simhash(items: Column) -> Column:
    """Bit b is set if more of the hashes have it than lack it."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda out, b: out.bitwiseOR(
            F.when(
                F.aggregate(
                    items, F.lit(0),
                    lambda n, h: n + F.when(F.call_function("getbit", h, b) == 1, F.lit(1)).otherwise(F.lit(-1)),
                ) > 0,
                F.call_function("shiftleft", F.lit(1).cast("long"), b),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )


def block_values(fingerprint: Column) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, i * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).alias("value"))
            for i in range(BLOCKS)
        ]
    )


def dense_starts(hits: DataFrame, threshold: float) -> DataFrame:
    """(id, text_key, length, start): windows of `length` that end with a hit and hold threshold x length hits or more.

    `hits` are distinct (id, text_key, length, pos).
    """
    least = F.ceil(F.lit(threshold) * F.col("length") - F.lit(1e-9)).cast("int")
    grouped = hits.groupBy("id", "text_key", "length").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    grouped = grouped.withColumn("least", F.greatest(least, F.lit(1))).where(F.size("at") >= F.col("least"))
    ends = F.filter("at", lambda p, i: F.get("at", i - F.col("least") + 1) > p - F.col("length"))
    starts = grouped.select("id", "text_key", "length", F.explode(ends).alias("end"))
    return starts.select("id", "text_key", "length", F.greatest(F.lit(0), F.col("end") - F.col("length") + 1).alias("start")).distinct()


def rarest(counts: DataFrame, threshold: float) -> DataFrame:
    """(key, length, hash): of each item's shingles (key, length, hash, n) the rarest among all items, so many that a window
    without any of them lacks too much."""
    seen = counts.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("items", "hash").rowsBetween(Window.unboundedPreceding, -1))
    spare = F.col("length") - F.ceil(F.lit(threshold) * F.col("length") - F.lit(1e-9))
    return counts.join(seen, "hash").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= spare).select("key", "length", "hash")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", size: int = 5, radius: int = 23, threshold: float = 0.8,
) -> DataFrame:
    """(id, text_key, item_id, similarity, first_word, n_words): for every document and benchmark item whose best
    window reaches `threshold`, that window (the first of equal ones). `text_key` is a hash of the text.

    Windows lie inside the document; of a document shorter than an item the window is the document. Null texts and
    texts or items of fewer than `size` words match nothing. Equal rows come back once, rows with equal ids and
    different texts each; null ids are kept; equal item texts are found under each of their ids. Other columns are
    ignored.
    """
    source = docs.where(F.col(text_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text")
    )
    texts = benchmark.select(F.col(item_column).alias("item"), shingles(F.col(item_text), size).alias("own")).where(F.size("own") > 0)
    texts = written(texts.select("item", "own", F.xxhash64("own").alias("key")).distinct(), "texts")
    items = written(texts.dropDuplicates(["key"]).select("key", "own", F.size("own").alias("length"), simhash(F.col("own")).alias("print")), "items")
    # Exploded tables are written, so that Spark knows their sizes when it chooses joins.
    counts = written(items.select("key", "length", F.explode("own").alias("hash")).groupBy("key", "length", "hash").agg(F.count(F.lit(1)).alias("n")), "counts")
    sought = written(counts.select("length", "hash").distinct(), "sought")

    numbered = source.select("id", "text_key", F.posexplode(shingles(F.col("text"), size)).alias("pos", "hash"))
    hits = numbered.join(sought, "hash").select("id", "text_key", "length", "pos").distinct()
    starts = written(dense_starts(hits, threshold), "starts")

    hit = written(starts.select(F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct(), "hit")
    with_hits = source.join(checked_broadcast(hit), (F.col("text_key") == F.col("hit_key")) & F.col("id").eqNullSafe(F.col("hit_id")), "left_semi")
    whole = with_hits.dropDuplicates(["id", "text_key"]).select(
        F.col("id").alias("hit_id"), F.col("text_key").alias("hit_key"), shingles(F.col("text"), size).alias("all")
    )
    place = ["id", "text_key", "length", "start"]
    windows = (
        starts.join(whole, (F.col("text_key") == F.col("hit_key")) & F.col("id").eqNullSafe(F.col("hit_id")))
        .select(*place, F.expr("slice(all, start + 1, length)").alias("window"))
    )
    # Equal windows of one length, such as those of copies, are one.
    printed = written(windows.withColumn("same", F.xxhash64("length", "window")), "windows")
    distinct = written(printed.dropDuplicates(["same"]).select("same", "length", "window", simhash(F.col("window")).alias("window_print")), "prints")

    shared = distinct.select("same", "length", "window_print", F.explode(F.array_distinct("window")).alias("hash"))
    asked = shared.join(rarest(counts, threshold), ["length", "hash"]).select("same", "length", "window_print", "key").distinct()
    near = radius // BLOCKS
    masks = F.array(*[F.lit(m).cast("long") for m in range(2**BLOCK_BITS) if bin(m).count("1") <= near])
    blocks = items.select("key", "print", F.explode(block_values(F.col("print"))).alias("b"))
    values = F.explode(F.transform(masks, lambda m: F.col("b.value").bitwiseXOR(m)))
    index = written(blocks.select("key", "print", "b.block", values.alias("value")), "index")
    probes = asked.select("same", "key", "window_print", F.explode(block_values(F.col("window_print"))).alias("b"))
    close = (
        probes.select("same", "key", "window_print", "b.block", "b.value").join(index, ["key", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("window_print"))) <= radius)
        .select("same", "key").distinct()
    )
    close = written(close, "close")
    held = distinct.join(close, "same").select("same", "key", F.size("window").alias("size"), F.explode("window").alias("hash"))
    held = held.groupBy("same", "key", "size", "hash").agg(F.count(F.lit(1)).alias("c"))
    smaller = held.join(counts, ["key", "hash"]).groupBy("same", "key", "size", "length").agg(F.sum(F.least("c", "n")).alias("m"))
    scored = smaller.select("same", "key", "size", (F.col("m") / (F.col("size") + F.col("length") - F.col("m"))).alias("similarity"))
    scored = written(scored.where(F.col("similarity") >= threshold), "scored")
    best = printed.select("id", "text_key", "start", "same").join(scored, "same").groupBy("id", "text_key", "key").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.col("size").alias("n"))).alias("best")
    )
    return best.join(texts.select("key", "item"), "key").select(
        F.col("id").alias(id_column), "text_key", F.col("item").alias(item_column), F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("first_word"), (F.col("best.n") + size - 1).alias("n_words"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; all columns, null texts included."""
    found = contaminated(docs, benchmark, id_column, text_column, **options)
    bad = written(found.select(F.col(id_column).alias("bad_id"), F.col("text_key").alias("bad_key")).distinct(), "bad")
    equal = F.col(id_column).eqNullSafe(F.col("bad_id")) & F.xxhash64(text_column).eqNullSafe(F.col("bad_key"))
    return docs.join(checked_broadcast(bad), equal, "left_anti")
