"""Near copies by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits; rows link where fingerprints differ in at most two. The steps:

1. Fingerprints of whole texts; equal ones are one class, whatever the number of rows.
2. Segments: A and B of 24 bits, C of 16. A and B are decoded by the extended Golay code: a 24-bit word has either one
   codeword within three bits or six at four bits. Words that differ in one bit always have a codeword in common: if one
   lies at four bits, the flipped bit belongs to exactly one of its six error patterns, and the other one has that codeword.
3. Pigeonhole of two errors on three segments gives five kinds of keys, so that every link has one in common:
   (B, codeword of A), (A, codeword of B), (C, codewords of A and B), (B, C), (A, C); 18 keys a fingerprint on average.
   Unrelated fingerprints share a key with a probability of about 2**-31.
4. Keys held by few fingerprints are joined and their pairs compared. Fingerprints of keys held by many (a family of
   edited copies) go another way, linear in their number: every one is listed under itself and its 64 neighbours; a list
   holds at most 65 fingerprints, any two of which differ in two bits at most, so a star links them.
5. Connected components of the links.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import CHUNK, checked_broadcast, components, scratch, text_bytes, written

#: Fixed: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Hashes whose bits are counted at once.
POOL = 1 << 16
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


# --- fingerprints --------------------------------------------------------------------------------------


def pieces(data: bytes):
    """Lists of words of a text, about CHUNK bytes at once, cut between words."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + CHUNK, n)
        while end < n and data[end] not in b" \t\n\v\f\r":
            end += 1
        yield data[start:end].translate(LOWER).split()
        start = end


def shingle_hashes(data: bytes, size: int):
    """XXH64 values of the runs of `size` words (of all words where there are fewer), in arrays."""
    from xxhash import xxh64_intdigest

    held: list[bytes] = []
    any_run = False
    for words in pieces(data):
        held += words
        if len(held) < size:
            continue
        any_run = True
        runs = map(b" ".join, zip(*(held[i:] for i in range(size)), strict=False))
        yield np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(held) - size + 1)
        held = held[len(held) - size + 1 :]
    if held and not any_run:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def majority(batch_texts: pa.Array, size: int) -> np.ndarray:
    """The fingerprint of every text: a bit is set if over half of its shingles' hashes have it."""
    data, offsets = text_bytes(batch_texts)
    rows = len(offsets) - 1
    ones, counts = np.zeros((rows, 64), np.int64), np.zeros(rows, np.int64)
    pool: list[np.ndarray] = []
    owners: list[int] = []

    def count():
        lengths = np.array([len(x) for x in pool])
        bits = np.unpackbits(np.concatenate(pool).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0, dtype=np.int64)
        np.add.at(ones, owners, sums)
        np.add.at(counts, owners, lengths)

    held = 0
    for row in range(rows):
        for found in shingle_hashes(data[offsets[row] : offsets[row + 1]].tobytes(), size):
            pool.append(found)
            owners.append(row)
            held += len(found)
            if held >= POOL:
                count()
                pool, owners, held = [], [], 0
    if pool:
        count()
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3) -> DataFrame:
    """(id, text_key, fingerprint) of every row: whole texts, A-Z lower-cased; zero for null and blank texts."""

    def run(batches):
        for batch in batches:
            found = pa.array(majority(batch.column(1), size).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(2), found], names=["id", "text_key", "fingerprint"])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("text_key"))
    return source.mapInArrow(run, "id long, text_key long, fingerprint long")


# --- keys ----------------------------------------------------------------------------------------------


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the bytes at three places, error patterns of each syndrome, how many there are: one or six)."""

    def syndrome(word: int) -> int:
        rest = word & 0x7FFFFF
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << bit - 11
        return rest | (word.bit_count() & 1) << 11

    of_bytes = np.array([[syndrome(b << 8 * place) for b in range(256)] for place in range(3)], np.uint32)
    patterns, many = np.zeros((4096, 6), np.uint32), np.zeros(4096, np.int64)
    for weight in range(5):
        for places in combinations(range(24), weight):
            error = sum(1 << p for p in places)
            at = syndrome(error)
            if weight < 4 or many[at] == 0 or int(patterns[at, 0]).bit_count() == 4:
                patterns[at, many[at]] = error
                many[at] += 1
    return of_bytes, patterns, many


def codewords(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the nearest codewords of 24-bit words, in six columns, and how many columns count."""
    of_bytes, patterns, many = tables
    words = words.astype(np.uint32)
    at = of_bytes[0][words & 255] ^ of_bytes[1][words >> 8 & 255] ^ of_bytes[2][words >> 16]
    return ((words[:, None] ^ patterns[at]) >> 11 & 0xFFF).astype(np.uint64), many[at]


def fuzzy_keys(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of each fingerprint."""
    a, b, c = prints & np.uint64(0xFFFFFF), prints >> np.uint64(24) & np.uint64(0xFFFFFF), prints >> np.uint64(48)
    (near_a, many_a), (near_b, many_b) = codewords(a, tables), codewords(b, tables)
    column = np.arange(6)
    has_a, has_b = column < many_a[:, None], column < many_b[:, None]
    rows = np.arange(len(prints))

    def kind(k, values):
        return values | np.uint64(k << 41)

    found = [
        (has_a, kind(1, b[:, None] << np.uint64(12) | near_a)),
        (has_b, kind(2, a[:, None] << np.uint64(12) | near_b)),
        (
            (has_a[:, :, None] & has_b[:, None, :]).reshape(-1, 36),
            kind(3, c[:, None] << np.uint64(24) | (near_a[:, :, None] << np.uint64(12) | near_b[:, None, :]).reshape(-1, 36)),
        ),
        (np.ones((len(prints), 1), bool), kind(4, b << np.uint64(16) | c)[:, None]),
        (np.ones((len(prints), 1), bool), kind(5, a << np.uint64(16) | c)[:, None]),
    ]
    row = np.concatenate([np.broadcast_to(rows[:, None], has.shape)[has] for has, _ in found])
    return row, np.concatenate([keys[has] for has, keys in found])


def keyed(classes: DataFrame) -> DataFrame:
    """(key, fingerprint) for every key of every distinct fingerprint."""

    def run(batches):
        tables = golay_tables()
        for batch in batches:
            for at in range(0, len(batch), 4096):
                own = batch.column(0).slice(at, 4096).to_numpy().view(np.uint64)
                row, key = fuzzy_keys(own, tables)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64))], names=["key", "fingerprint"])

    return classes.select("fingerprint").mapInArrow(run, "key long, fingerprint long")


# --- links ---------------------------------------------------------------------------------------------


def apart(one: Column, two: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(two))


def links(classes: DataFrame, crowd: int = 32) -> DataFrame:
    """(a, b): pairs of fingerprints that differ in one or two bits, enough of them to connect all that do.

    Keys of at most `crowd` fingerprints give all their pairs; those of more are listed with their neighbours. The two
    ways have the same components, so `crowd` steers the work only.
    """
    keys = written(keyed(classes), "keys")
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    few = keys.join(checked_broadcast(shared.where(F.col("n") <= crowd).select("key")), "key")
    together = few.groupBy("key").agg(F.collect_list("fingerprint").alias("own"))
    pairs = (
        together.select(F.posexplode("own").alias("at", "a"), "own")
        .select("a", F.explode(F.filter("own", lambda x, i: (i > F.col("at")) & (apart(x, F.col("a")) <= 2))).alias("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )

    crowded = keys.join(checked_broadcast(shared.where(F.col("n") > crowd).select("key")), "key").select("fingerprint").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fingerprint").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    listed = crowded.select("fingerprint", F.explode(F.concat(F.array("fingerprint"), flips)).alias("place"))
    balls = listed.groupBy("place").agg(F.collect_list("fingerprint").alias("own")).where(F.size("own") > 1)  # 65 at most
    stars = balls.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def labelled(rows: DataFrame, crowd: int) -> DataFrame:
    """(fingerprint, root) of every fingerprint of `rows`."""
    classes = written(rows.select("fingerprint").distinct(), "classes")
    roots = components(links(classes, crowd)).toDF("fingerprint", "root")
    return classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, crowd: int = 32) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `docs`: its 64-bit fingerprint over runs of `size` words, and the
    smallest id that links of two or fewer differing bits reach, its own included.

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Equal rows and equal ids all come
    back; a null id takes part in links, and a component of null ids only has a null component_id. Other columns are
    ignored. An empty table gives none.
    """
    with scratch(docs.sparkSession):
        rows = written(fingerprints(docs, id_column, text_column, size), "fingerprints", keep=True)
        roots = written(labelled(rows, crowd), "roots", keep=True)
    lows = rows.groupBy("fingerprint").agg(F.min("id").alias("low")).join(roots, "fingerprint")
    lowest = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = roots.join(lowest, "root").select(F.col("fingerprint").alias("own"), "component_id")
    return rows.join(of_class, F.col("fingerprint") == F.col("own")).select(F.col("id").alias(id_column), "fingerprint", "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 3, crowd: int = 32) -> DataFrame:
    """`docs` with the rows of one (id, text) of each component: the smallest id (null last), then the smallest text hash.

    Texts without words all have the fingerprint zero, so one of them stays.
    """
    with scratch(docs.sparkSession):
        rows = written(fingerprints(docs, id_column, text_column, size), "fingerprints")
        rank = F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key")
        lows = rows.groupBy("fingerprint").agg(F.min(rank).alias("low")).join(labelled(rows, crowd), "fingerprint")
        first = lows.groupBy("root").agg(F.min("low").alias("low"))
        kept = written(first.select(F.col("low.id").alias("kept_id"), F.col("low.text_key").alias("kept_key")), "kept", keep=True)
    return docs.join(kept, F.col(id_column).cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64(text_column) == F.col("kept_key")), "left_semi")
