"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts only those at minimisers are retained: word positions whose hash of the next `gram`
words is the least among `window` neighbouring positions. The choice depends on content alone, so both copies of a
passage of at least gram + window - 1 words retain the same suffix inside it. The steps:

1. Count the retained suffixes' grams over the whole corpus; only grams that occur at least twice go on, through a
   Bloom filter of fixed size.
2. Deal the suffixes that go on out by gram. Those of a gram that is very frequent are dealt out by content, not at
   random: by the hash of each stretch of `least` words around the gram, so all copies of a stretch meet.
3. Compare the suffixes of a gram by the words kept before and after it (as many as lie between two minimisers): for
   every number of words before it, those that agree in these and in the words after it that make up `least`. A
   passage of `least` words holds a gram that all its copies retain, so none is missed, whatever else shares parts.
4. Per document, join the matches and keep the stretches of at least `least` words.

Words are compared by 32 bits of their hashes, grams by 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import bit_map, hashed_words, most_frequent, rolling_hashes, signed, written

#: Bits of the Bloom filter of repeated grams: 16 MB, whatever the corpus.
BLOOM_BITS = 1 << 27
#: Half the number of a gram's suffixes up to which they are compared in one task.
DEALT = 500


def windowed(values: np.ndarray, window: int, pick) -> np.ndarray:
    """`pick` (minimum or maximum) over every `window` neighbours, by doubling."""
    done, span = values, 1
    while 2 * span <= window:
        done = pick(done[:-span], done[span:])
        span *= 2
    return pick(done[: len(done) - (window - span)], done[window - span :])


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some `window` neighbours; fewer positions than that have none."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = windowed(grams, window, np.minimum)
    edge = np.zeros(window - 1, grams.dtype)
    return np.flatnonzero(windowed(np.concatenate((edge, least, edge)), window, np.maximum) == grams)


def retained(batch: pa.RecordBatch, gram: int, window: int):
    """(row, word hashes, positions, gram hashes) of the texts in column 1 that retain any suffix."""
    for first, words, offsets in hashed_words(batch.column(1), lower=False):
        grams = rolling_hashes(words, gram)
        for i in np.flatnonzero(np.diff(offsets) >= gram + window - 1).tolist():
            start, end = offsets[i], offsets[i + 1]
            at = minimisers(grams[start : end - gram + 1], window)
            yield first + i, words[start:end], at, grams[start + at]


def gram_counts(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(gram, n): how often each retained gram occurs, if more than once."""

    def run(batches):
        for batch in batches:
            found = [x[3] for x in retained(batch, gram, window)]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([signed(values), pa.array(counts)], names=["gram", "n"])

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")


def bloom(grams: DataFrame) -> np.ndarray:
    low = F.col("gram").bitwiseAND(F.lit(BLOOM_BITS - 1))
    high = F.shiftrightunsigned("gram", 37).bitwiseAND(F.lit(BLOOM_BITS - 1))
    return bit_map(grams.select(F.explode(F.array(low, high)).alias("bit")), BLOOM_BITS)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted `wanted`."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def passes(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash is in the Bloom filter."""
    low = values & np.uint64(BLOOM_BITS - 1)
    high = (values >> np.uint64(37)) & np.uint64(BLOOM_BITS - 1)
    both = (bits[low >> np.uint64(5)] >> (low & np.uint64(31)).astype(np.uint32)) & (bits[high >> np.uint64(5)] >> (high & np.uint64(31)).astype(np.uint32)) & 1
    return both.astype(bool)


def stretches_around(words: np.ndarray, at: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the text's stretches of `least` words that hold the gram at any position of `at`."""
    hashes = rolling_hashes(words, least)
    near = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(near, np.maximum(at - window + 1, 0), 1)
    np.add.at(near, np.minimum(at + 1, len(hashes)), -1)
    starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    return starts, hashes[starts]


def stretch_counts(docs: DataFrame, gram: int, least: int, frequent) -> DataFrame:
    """(gram, n): how often each stretch of `least` words around a frequent gram occurs, if more than once; `gram` is
    the hash of the whole stretch."""
    window = least - gram + 1

    def run(batches):
        for batch in batches:
            found = []
            for _, words, at, grams in retained(batch, gram, window):
                hot = among(grams, frequent.value)
                if hot.any():
                    found.append(stretches_around(words, at[hot], least, window)[1])
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([signed(values), pa.array(counts)], names=["gram", "n"])

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")


def stretch_places(docs: DataFrame, gram: int, least: int, frequent, often, repeated) -> DataFrame:
    """(gram, doc, text_key, first, last): places of stretches around frequent grams. `gram` is null if the words
    first to last - 1 are covered by stretches that are in `often`; else it is the hash of one stretch that may
    repeat by the Bloom filter `repeated`."""
    window = least - gram + 1

    def run(batches):
        for batch in batches:
            docs_in = batch.column(0)
            hashes, rows, firsts, lasts = [], [], [], []
            for row, words, at, grams in retained(batch, gram, window):
                hot = among(grams, frequent.value)
                if not hot.any():
                    continue
                starts, values = stretches_around(words, at[hot], least, window)
                known = among(values, often.value)
                if known.any():
                    own = starts[known]
                    cut = np.flatnonzero(np.diff(own) > least)
                    first, last = own[np.r_[0, cut + 1]], own[np.r_[cut, len(own) - 1]] + least
                    hashes.append(pa.nulls(len(first), pa.int64()))
                    rows.append(np.full(len(first), row))
                    firsts.append(first)
                    lasts.append(last)
                open_ = ~known & passes(values, repeated.value)
                if open_.any():
                    hashes.append(signed(values[open_]))
                    rows.append(np.full(int(open_.sum()), row))
                    firsts.append(starts[open_])
                    lasts.append(starts[open_] + least)
            if rows:
                at_rows = pa.array(np.concatenate(rows))
                columns = [pa.concat_arrays(hashes), docs_in.take(at_rows), batch.column(2).take(at_rows), pa.array(np.concatenate(firsts), pa.int64()), pa.array(np.concatenate(lasts), pa.int64())]
                yield pa.record_batch(columns, names=["gram", "doc", "text_key", "first", "last"])

    return docs.mapInArrow(run, "gram long, doc long, text_key long, first long, last long")


def frequent_matches(docs: DataFrame, gram: int, least: int, frequent, most: int) -> DataFrame:
    """(doc, text_key, first, last) as `matches` has them, for the grams that are `frequent`.

    Stretches that are very frequent themselves are known to every task. The others meet by their hash, so that no
    key has many rows.
    """
    context = docs.sparkSession.sparkContext
    counts = written(stretch_counts(docs, gram, least, frequent), "stretches")
    often, repeated = context.broadcast(frequent_grams(counts, most)), context.broadcast(bloom(counts))
    places = written(stretch_places(docs, gram, least, frequent, often, repeated), "places")
    met = places.where("gram IS NOT NULL").join(counts.select("gram"), "gram", "left_semi")
    return places.where("gram IS NULL").unionByName(met).drop("gram")


def suffixes(docs: DataFrame, gram: int, window: int, repeated, frequent) -> DataFrame:
    """(gram, doc, text_key, pos, left, right): suffixes whose gram may repeat and is not `frequent`, with the words
    around the gram."""

    def run(batches):
        for batch in batches:
            docs_in = batch.column(0)
            out: list[list] = [[], [], [], [], []]
            for row, words, at, grams in retained(batch, gram, window):
                keep = passes(grams, repeated.value) & ~among(grams, frequent.value)
                at, grams = at[keep], grams[keep]
                if not len(at):
                    continue
                small = (words >> np.uint64(32)).astype(">u4")
                out[0].append(grams)
                out[1].append(np.full(len(at), row))
                out[2].append(at)
                out[3] += [small[max(0, p - window) : p].tobytes() for p in at.tolist()]
                out[4] += [small[p + gram : p + gram + window].tobytes() for p in at.tolist()]
            if out[3]:
                rows = pa.array(np.concatenate(out[1]))
                columns = [signed(np.concatenate(out[0])), docs_in.take(rows), batch.column(2).take(rows), pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())]
                yield pa.record_batch(columns, names=["gram", "doc", "text_key", "pos", "left", "right"])

    return docs.mapInArrow(run, "gram long, doc long, text_key long, pos int, left binary, right binary")


def common(a: bytes, b: bytes) -> int:
    """Words of 4 bytes that `a` and `b` share at their beginnings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a[:n], ">u4"), np.frombuffer(b[:n], ">u4")
    return int(np.argmin(x == y))


def backwards(left: bytes) -> bytes:
    return np.frombuffer(left, ">u4")[::-1].tobytes()


def reaches(around: list[tuple[bytes, bytes]], spare: int) -> list[tuple[int, int] | None]:
    """For each of several places of one gram, given by the words before and after it: how many words before and
    after it lie in stretches, the gram and `spare` words more, that another place repeats."""
    if len(around) == 2:
        (left, right), (other_left, other_right) = around
        reach = common(backwards(left), backwards(other_left)), common(right, other_right)
        return [reach if sum(reach) >= spare else None] * 2
    places: dict[tuple[bytes, bytes], list[int]] = {}
    for i, x in enumerate(around):
        places.setdefault(x, []).append(i)
    out: list[tuple[int, int] | None] = [None] * len(around)
    met: dict[tuple[bytes, bytes], list[int]] = {x: [] for x in places}
    for before in range(spare + 1):
        shared: dict[tuple[bytes, bytes], list[tuple[bytes, bytes]]] = {}
        for x in places:
            left, right = x
            if len(left) >= 4 * before and len(right) >= 4 * (spare - before):
                shared.setdefault((left[len(left) - 4 * before :], right[: 4 * (spare - before)]), []).append(x)
        for own in shared.values():
            if len(own) > 1 or len(places[own[0]]) > 1:
                for x in own:
                    met[x].append(before)
    for x, own in met.items():
        for i in places[x] if own else ():
            out[i] = own[-1], spare - own[0]
    return out


def matches(found: DataFrame, gram: int, least: int) -> DataFrame:
    """(doc, text_key, first, last): words first to last - 1 of a text, at least `least`, that another place of the
    gram in their middle repeats; every place is compared with every other by the stretches of `least` words."""

    def compared(rows, out):
        if len(rows) > 1:
            for (doc, key, pos, *_), reach in zip(rows, reaches([x[3:] for x in rows], least - gram), strict=True):
                if reach:
                    out.add((doc, key, pos - reach[0], pos + gram + reach[1]))

    def run(batches):
        held, current, out = [], None, set()

        def rows():
            columns = zip(*out, strict=True)
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc", "text_key", "first", "last"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "doc", "text_key", "pos", "left", "right")]
            for g, doc, key, pos, left, right in zip(*columns, strict=True):
                if g != current:
                    compared(held, out)
                    held, current = [], g
                    if len(out) > 50_000:
                        yield rows()
                        out.clear()
                held.append((doc, key, pos, left, right))
        compared(held, out)
        if out:
            yield rows()

    ordered = found.repartition("gram").sortWithinPartitions("gram")
    return ordered.mapInArrow(run, "doc long, text_key long, first long, last long")


def frequent_grams(counts: DataFrame, most: int) -> np.ndarray:
    """The grams seen more than 2 * DEALT times, sorted; at most `most`, the most frequent."""
    rows = most_frequent(counts, 2 * DEALT + 1, most).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 50, gram: int = 25, dealt: int = 1_000_000,
) -> DataFrame:
    """(id, first_word, n_words): stretches of at least `least` words that occur elsewhere too, in another
    document or place, word for word. Words are numbered from 0.

    `gram` is the length of the hashed words at a suffix's start; every `least` words retain a suffix. Null and
    short texts have no stretches. Equal rows repeat each other and come back once; null ids come back as null; a
    text of one repeated word repeats itself. Other columns are ignored. `dealt` bounds the lists of very frequent
    grams and stretches; what is beyond them is compared all the same, each gram in one task.
    """
    window = least - gram + 1
    context = docs.sparkSession.sparkContext
    id_, text = F.col(id_column).cast("long"), F.col(text_column)
    source = docs.where(text.isNotNull()).select(id_.alias("id"), text.alias("text"), F.xxhash64(id_, text).alias("key"))
    counts = written(gram_counts(source, gram, window), "grams")
    repeated, frequent = context.broadcast(bloom(counts)), context.broadcast(frequent_grams(counts, dealt))
    found = matches(suffixes(source, gram, window, repeated, frequent), gram, least)
    if len(frequent.value):
        found = found.unionByName(frequent_matches(source, gram, least, frequent, dealt))

    text_order = Window.partitionBy("doc", "text_key").orderBy("first", "last")
    reached = F.max("last").over(text_order.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.distinct().withColumn("new", F.coalesce((F.col("first") > reached).cast("int"), F.lit(1)))
    numbered = islands.withColumn("island", F.sum("new").over(text_order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("doc", "text_key", "island").agg(F.min("first").alias("first_word"), F.max("last").alias("last"))
    return joined.select(F.col("doc").alias(id_column), "first_word", (F.col("last") - F.col("first_word")).alias("n_words"))
