"""N-gram Jaccard join with set-relation skipping.

Sets of word shingles whose Jaccard similarity reaches a threshold are linked; every document gets its set's
size and its component. The steps:

1. Equal sets become one class (a hash of the sorted set). Every document is read whole.
2. Shingles seen in many sets come last in the global order, the others come first, by hash. The list of
   frequent ones only shapes the order, never the result, so it may be bounded (`frequent`).
3. Index lists: each class posts the prefix of its ordered set, (shingle, class, size, position). Two classes
   that reach the threshold share a prefix shingle.
4. Answers from relations: in each list longer than `short`, the class with the largest share of frequent
   shingles is the list's centre. Classes verified as similar to a centre take over its answer: they are in one
   component, and no pair within a component is looked at again.
5. Block skipping: the lists' entries are sorted by size and cut into blocks; a pair of blocks whose sizes and
   positions cannot reach the threshold is skipped as a whole, the rest entry by entry. In long lists, sketches
   (parities of the shingles in SKETCH_BITS cells) bound how much two sets differ. Only pairs of different
   components come out, and pairs that share too few prefix shingles go before any set is fetched.
6. Sets of the remaining pairs are fetched through a Bloom filter of fixed size and compared exactly.

Hashes have 64 bits; two different shingles, or sets, with one hash would count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import (
    bit_map, checked_broadcast, components, hashed_words, mixed, most_frequent, scratch, shingle_hashes, signed, written,
)

#: Tokens counted at once for the frequent list.
COUNTED = 1 << 21
#: Two sets differ in at least as many shingles as their sketches in bits.
SKETCH_BITS = 1024
KNOWN = ("token", "key", "n", "pos", "part", "sketch")


def sketch(found: np.ndarray) -> bytes:
    cells = np.bincount((found & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def unpacked(column: pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ two).sum(axis=1).astype(np.int64)


def row_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct shingle hashes, hash of the set) of the texts in column 1, lower-cased (A-Z)."""
    for first, words, offsets in hashed_words(batch.column(1), lower=True):
        for i in range(len(offsets) - 1):
            found = np.unique(shingle_hashes(words[offsets[i] : offsets[i + 1]], size))
            yield first + i, found, set_hash(found)


def set_hash(found: np.ndarray) -> int:
    if not len(found):
        return 0
    places = np.arange(1, len(found) + 1, dtype=np.uint64)
    total = mixed((found * (places * np.uint64(2) + np.uint64(1))).sum(keepdims=True) + np.uint64(len(found)))
    return int(total.view(np.int64)[0])


def sizes_and_frequent(docs: DataFrame, size: int) -> DataFrame:
    """Two kinds of rows: documents (id, text_key, n, key = hash of the set, sketch where the task meets the set first)
    and shingles seen in several sets of a task (key, n = how many)."""
    names = ["id", "text_key", "n", "key", "document", "sketch"]

    def run(batches):
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        pooled = 0

        def counted():
            values, counts = np.unique(np.concatenate(pool), return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            none = pa.nulls(len(values), pa.int64())
            columns = [none, none, pa.array(counts, pa.int64()), signed(values), pa.array(np.zeros(len(values), bool)), pa.nulls(len(values), pa.binary())]
            return pa.record_batch(columns, names=names)

        for batch in batches:
            counts, keys, sketches = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [None] * len(batch)
            for row, found, key in row_sets(batch, size):
                counts[row], keys[row] = len(found), key
                if len(found) and key not in seen:
                    seen.add(key)
                    sketches[row] = sketch(found)
                    pool.append(found)
                    pooled += len(found)
                    if pooled > COUNTED:
                        yield counted()
                        pool, pooled, seen = [], 0, set()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts), pa.array(keys), pa.array(np.ones(len(batch), bool)), pa.array(sketches, pa.binary())], names=names)
        if pool:
            yield counted()

    return docs.mapInArrow(run, "id long, text_key long, n long, key long, document boolean, sketch binary")


def frequent_order(counts: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` shingles seen at least `least` times: (sorted hashes, their ranks by frequency)."""
    sums = written(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "sums")
    rows = most_frequent(sums, least, most).toPandas()
    keys, n = rows["key"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def index_entries(docs: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """(token, key, n, pos, share): the prefixes of the ordered sets; `share` is 1000 x the frequent part of the set."""

    def run(batches):
        tokens, ranks = frequent.value
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for _, found, key in row_sets(batch, size):
                n = len(found)
                if not n or key in seen:
                    continue
                seen.add(key)
                p = prefix_length(n, percent)
                share = 0
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    rank = np.where(tokens[at] == found, ranks[at], 0)
                    if hot := int((rank > 0).sum()):
                        share = 1000 * hot // n
                        found = found[np.lexsort((found, rank))]
                out.append((found[:p], key, n, share))
            if out:
                lengths = [len(x[0]) for x in out]
                each = lambda i: pa.array(np.repeat(np.array([x[i] for x in out], np.int64), lengths))
                place = np.concatenate([np.arange(x, dtype=np.int64) for x in lengths])
                columns = [signed(np.concatenate([x[0] for x in out])), each(1), each(2).cast("int32"), pa.array(place.astype(np.int32)), each(3).cast("int16")]
                yield pa.record_batch(columns, names=["token", "key", "n", "pos", "share"])

    return docs.mapInArrow(run, "token long, key long, n int, pos int, share short")


def _groups(batches, columns: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """A partition's columns sorted by token, and the starts of its tokens' runs (with the end)."""
    table = pa.Table.from_batches([b.select(columns) for b in batches])
    if not len(table):
        return [], np.zeros(1, np.int64)
    arrays = [table.column(c).to_numpy() for c in columns]
    order = np.argsort(arrays[0], kind="stable")
    arrays = [a[order] for a in arrays]
    starts = np.flatnonzero(np.r_[True, arrays[0][1:] != arrays[0][:-1]])
    return arrays, np.r_[starts, len(order)]


def shared_entries(entries: DataFrame, short: int) -> DataFrame:
    """Entries of tokens in at least two sets, once for each set; `centre` is the list's centre in long lists."""
    names = ["token", "key", "n", "pos", "share"]

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        arrays, bounds = _groups(batches, names)
        del batches
        if not arrays:
            return
        token, key, n, pos, share = arrays
        # Copies of one set that other tasks posted: keep the first.
        order = np.lexsort((key, token))
        token, key, n, pos, share = (x[order] for x in (token, key, n, pos, share))
        keep = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, key, n, pos, share = (x[keep] for x in (token, key, n, pos, share))
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        counts = np.diff(np.r_[starts, len(token)])
        group = np.repeat(np.arange(len(starts)), counts)
        best = np.lexsort((key, -n.astype(np.int64), -share.astype(np.int64), group))
        centre = key[best][starts][group]
        keep = counts[group] > 1
        long = pa.array(counts[group] > short)
        columns = [pa.array(token), pa.array(key), pa.array(n), pa.array(pos)]
        centres = pa.compute.if_else(long, pa.array(centre), pa.scalar(None, pa.int64()))
        yield from pa.table([*columns, centres], names=["token", "key", "n", "pos", "centre"]).filter(pa.array(keep)).to_batches(1 << 16)

    return entries.repartition("token").mapInArrow(run, "token long, key long, n int, pos int, centre long")


def listed_pairs(entries: DataFrame, percent: int, block: int = 64) -> DataFrame:
    """(a, b, na, nb) for each token's pairs of different components that its positions, and in long lists the
    sketches, allow; a < b."""

    def reach(n, pos, x, y):
        overlap = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
        good = (100 + percent) * overlap >= percent * (n[x] + n[y])
        return good & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))

    def ordered(key, n, x, y):
        flip = key[x] > key[y]
        x, y = np.where(flip, y, x), np.where(flip, x, y)
        return key[x], key[y], n[x], n[y]

    def pairs(key, n, pos, part, sketches):
        """Pairs of one list, by blocks of entries in the order of size: those of the largest component only with
        entries of others."""
        order = np.argsort(n, kind="stable")
        key, n, pos, part = key[order], n[order], pos[order], part[order]
        sketches = sketches[order] if sketches is not None else None
        values, counts = np.unique(part, return_counts=True)
        large = part == values[counts.argmax()]
        rows, rest = np.flatnonzero(~large), n - pos - 1
        for at in range(0, len(rows), block):
            own = rows[at : at + block]
            low = np.searchsorted(n, -(-percent * n[own[0]] // 100))
            high = np.searchsorted(n, 100 * n[own[-1]] // percent, "right")
            for start in range(low, high, block):
                end = min(start + block, high)
                most = min(pos[own].max(), pos[start:end].max()) + 1 + min(rest[own].max(), rest[start:end].max())
                if (100 + percent) * most < percent * (n[own[0]] + n[start]):
                    continue  # no pair of these blocks can reach the threshold
                x, y = np.meshgrid(own, np.arange(start, end), indexing="ij")
                x, y = x.ravel(), y.ravel()
                good = (part[x] != part[y]) & (large[y] | (x < y)) & reach(n, pos, x, y)
                x, y = x[good], y[good]
                if sketches is not None and len(x):
                    good = (100 + percent) * (n[x] + n[y] - differ(sketches[x], sketches[y])) >= 2 * percent * (n[x] + n[y])
                    x, y = x[good], y[good]
                if len(x):
                    yield ordered(key, n, x, y)

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        arrays, bounds = _groups(batches, ["token", "key", "n", "pos", "part"])
        if not arrays:
            return
        table = pa.Table.from_batches([b.select(["token", "sketch"]) for b in batches])
        sketches = table.column("sketch").combine_chunks().take(pa.array(np.argsort(table.column("token").to_numpy(), kind="stable")))
        del batches, table
        out, held = [], 0

        def flush():
            a, b, x, y = (np.concatenate([o[i] for o in out]) for i in range(4))
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(x), pa.array(y)], names=["a", "b", "na", "nb"])

        _, key, n, pos, part = arrays
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        lengths = np.diff(bounds)
        # Most lists have two entries; these go in one step.
        x = bounds[:-1][lengths == 2]
        y = x + 1
        good = (part[x] != part[y]) & reach(n, pos, x, y)
        if good.any():
            out.append(ordered(key, n, x[good], y[good]))
        for start, end in zip(bounds[:-1][lengths > 2], bounds[1:][lengths > 2], strict=True):
            if (part[start:end] == part[start]).all():
                continue  # the answer is known from the component
            own = sketches.slice(start, end - start)
            own = unpacked(own) if own.null_count == 0 else None
            for found in pairs(key[start:end], n[start:end], pos[start:end], part[start:end], own):
                out.append(found)
                held += len(found[0])
                if held > 200_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return entries.repartition("token").mapInArrow(run, "a long, b long, na long, nb long")


# --- sets of candidates --------------------------------------------------------------------------------

#: Bits of the Bloom filter that says whose sets are fetched: 8 MB, whatever the number of candidates.
BLOOM_BITS = 1 << 26


def bloom_of(rows: DataFrame) -> np.ndarray:
    """A bit map of fixed size with two bits set for every (id, key)."""
    low = F.col("key").bitwiseXOR(F.col("id")).bitwiseAND(F.lit(BLOOM_BITS - 1))
    high = F.shiftrightunsigned("key", 38).bitwiseXOR(F.col("id")).bitwiseAND(F.lit(BLOOM_BITS - 1))
    return bit_map(rows.select(F.explode(F.array(low, high)).alias("bit")), BLOOM_BITS)


def fetched_sets(docs: DataFrame, size: int, wanted) -> DataFrame:
    """(key, items): the sorted sets, 8 bytes each, of the documents (id, text) whose (id, key) may be wanted."""

    def run(batches):
        bits = wanted.value
        last = BLOOM_BITS - 1
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, blobs = [], []
            for row, found, key in row_sets(batch, size):
                if not len(found):
                    continue
                own = ids[row] or 0
                low, high = (key ^ own) & last, (((key & (1 << 64) - 1) >> 38) ^ own) & last
                if bits[low >> 5] >> np.uint32(low & 31) & 1 and bits[high >> 5] >> np.uint32(high & 31) & 1:
                    keys.append(key)
                    blobs.append(found.tobytes())
            if keys:
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "items"])

    return docs.select("id", "text").mapInArrow(run, "key long, items binary")


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the threshold; `classes` has key, n and sketch."""

    def run(batches):
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            away = differ(unpacked(batch.column("sa")), unpacked(batch.column("sb")))
            good = pa.array((100 + percent) * (n - away) >= 2 * percent * n)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(good)

    one, two = (classes.select("key", "n", "sketch").toDF(x, f"n{x}", f"s{x}") for x in "ab")
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Each set comes from its class's first document."""
    context = docs.sparkSession.sparkContext

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with scratch(docs.sparkSession):
        pairs = written(sketched(pairs, classes, percent), "pairs")
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = context.broadcast(bloom_of(classes.select("key", F.coalesce("id", F.lit(0)).alias("id")).join(keys, "key")))
        sets = written(fetched_sets(docs, size, wanted), "sets")
        one, two = sets.toDF("a", "xa"), sets.toDF("b", "xb")
        joined = pairs.join(two, "b").join(one, "a").select("a", "b", "xa", "xb")
        return written(joined.mapInArrow(run, "a long, b long"), "verified", keep=True)


# --- the join ------------------------------------------------------------------------------------------


def linked_classes(
    docs: DataFrame, id_column: str, text_column: str, size: int, percent: int, least: int, frequent: int, short: int,
) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, n, key) of every row, and (key, root) of every set that is linked with another one."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_key"))
    with scratch(docs.sparkSession):
        context = docs.sparkSession.sparkContext
        found = written(sizes_and_frequent(source, size), "sizes", keep=True)
        rows = found.where("document").select("id", "text_key", "n", "key")
        sets = found.where("document AND n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch", True).alias("sketch"))
        classes = written(sets, "classes")
        order = context.broadcast(frequent_order(found.where("NOT document"), least, frequent))

        entries = written(shared_entries(index_entries(source, size, percent, order), short), "entries")
        to_centre = (
            entries.where("centre IS NOT NULL AND centre <> key")
            .groupBy("key", "centre").agg(F.count(F.lit(1)).alias("times"))
            .groupBy("key").agg(F.max_by("centre", F.struct("times", "centre")).alias("centre"))
            .select(F.col("centre").alias("a"), F.col("key").alias("b"))
        )
        near = verified(source, to_centre, classes, size, percent)
        parts = components(near)

        known = entries.join(parts.toDF("key", "root"), "key", "left").withColumn("part", F.coalesce("root", "key"))
        long = known.where("centre IS NOT NULL").join(classes.select("key", "sketch"), "key")
        short_ones = known.where("centre IS NULL").withColumn("sketch", F.lit(None).cast("binary"))
        known = short_ones.select(*KNOWN).unionByName(long.select(*KNOWN))
        rest = "greatest({0}, {1})".format(*(f"(ceil({percent} * {n} / 100) - 1)" for n in ("na", "nb")))
        candidates = (
            listed_pairs(known, percent)
            .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
            .where(f"{100 + percent} * (shared + {rest}) >= {percent} * (na + nb)")
            .select("a", "b")
        )
        links = near.unionByName(verified(source, candidates, classes, size, percent))
        return rows, written(components(links).toDF("key", "root"), "roots", keep=True)


def jaccard_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80,
    least: int = 16, frequent: int = 1_000_000, short: int = 16,
) -> DataFrame:
    """(id, n_shingles, component_id) for every row of `docs`: the size of its set of `size`-word shingles and the
    smallest id that links reach; two rows link when their sets' Jaccard similarity is at least `percent` / 100.

    Null or blank texts have an empty set, linked with nothing: their component is their own id. A text with fewer
    words is one shingle. Equal rows, also with equal ids, all come back; a null id takes part in links, and a
    component of null ids only has a null component_id. Other columns are ignored. `least`, `frequent` and
    `short` steer the work, not the result: sightings from which a shingle counts as frequent, the most shingles
    held in that order, and the length above which a list has a centre.
    """
    rows, roots = linked_classes(docs, id_column, text_column, size, percent, least, frequent, short)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("low"))
    labelled = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = labelled.join(lowest, "root").select(F.col("key").alias("class"), "component_id")
    joined = rows.join(of_class, (F.col("key") == F.col("class")) & (F.col("n") > 0), "left")
    return joined.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 80,
    least: int = 16, frequent: int = 1_000_000, short: int = 16,
) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (null last), then of the smallest text hash.

    Rows without words all stay, as they are linked with nothing. Of rows with equal id and text one stays.
    """
    with scratch(docs.sparkSession):
        rows, roots = linked_classes(docs, id_column, text_column, size, percent, least, frequent, short)
        rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key")
        classes = written(rows.where("n > 0").groupBy("key").agg(F.min(rank).alias("low"), F.count(F.lit(1)).alias("rows")), "classes")
        labelled = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        first = labelled.groupBy("root").agg(F.min("low").alias("first"))
        of_class = labelled.join(first, "root").select(F.col("key").alias("class"), "first")
        ranked = rows.where("n > 0").join(of_class, F.col("key") == F.col("class")).select("id", "text_key", (rank == F.col("first")).alias("stays"))
        gone = written(ranked.where("NOT stays").select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone", keep=True)
        again = written(
            ranked.where("stays").groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")), "again", keep=True,
        )
    equal = F.col(id_column).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_column) == F.col("gone_key"))
    kept = docs.join(checked_broadcast(gone), equal, "left_anti")
    if again.isEmpty():
        return kept
    # Rows with equal id and text: one of each, apart from the others.
    return kept.join(again, equal, "left_anti").unionByName(kept.join(again, equal, "left_semi").dropDuplicates([id_column, text_column]))
