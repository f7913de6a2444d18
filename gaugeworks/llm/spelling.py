"""Grouping of spelling variants by a bit-sliced position index.

Words of the corpus are near if they differ by one inserted, deleted or replaced letter. The steps:

1. The vocabulary: words and their numbers over all texts, one aggregate with map-side sums.
2. Blocks: of two near words, the shorter one with m letters, the first or the second half is free of the error. So every
   word goes to blocks (m, equal prefix, equal suffix) for m = its length and one less; near words meet in one of them. A
   block over the limit is cut again: the stretch that may hold the error is halved, until it is one letter wide, where
   the alphabet bounds the block. No block needs more than one task's small memory, and no pair is lost.
3. In a block, only the open stretch is indexed: a bitset over the block's words for every (position, letter). All words
   of the block walk their letters at once. Three sets of candidates are kept as bits: those without an error so far,
   those with one replaced letter, and those with one letter more, whose positions are shifted by one. After the last
   letter, the set bits are the near words.
4. The form of a word is its most frequent near word, if that is frequent enough; roots follow forms by pointer jumping.
   The count at least doubles along a chain, so there are no circles, and a handful of rounds is enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import checked_broadcast, scratch, written

#: Letters: A-Z, a-z and U+00C0 to U+00FF, all of them single bytes in Latin-1. 26 + 64 of them are left in lower case.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words walked together where blocks are smaller; positions indexed at once.
TOGETHER = 512
POSITIONS = 64


def runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with a row for every maximal run of letters, as `run`, A-Z in lower case."""
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), UPPER, LOWER)
    return docs.withColumn("run", F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))))


def vocabulary(words: DataFrame, word: Column, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): distinct values of `word` with at least `letters` code points that occur `least` times or more."""
    counts = words.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least)


# --- blocks --------------------------------------------------------------------------------------------


def keyed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, a, b) with their block's key and the width of the open stretch."""
    return entries.select(
        "word", "n", "m", "a", "b", F.expr("m - a - b").alias("width"), F.expr("xxhash64(m, a, b, left(word, a), right(word, b))").alias("key")
    )


def halved(entries: DataFrame) -> DataFrame:
    """Every entry in two: the first half of its open stretch is equal, or the second is."""
    halves = F.expr("array(struct(a + (m - a - b) div 2 AS a, b AS b), struct(a AS a, m - a - (m - a - b) div 2 AS b))")
    cut = entries.select("word", "n", "m", F.explode(halves).alias("h"))
    return keyed(cut.select("word", "n", "m", F.col("h.a").cast("int").alias("a"), F.col("h.b").cast("int").alias("b")))


def blocks(words: DataFrame, limit: int, cells: int) -> DataFrame:
    """(key, width, core, word, n): members of blocks with two words or more; `core` is the open stretch of the word.

    Blocks of more than `limit` words, or of more than `cells` letters if they have over two words, are halved.
    """
    lengths = F.expr("array(length(word), length(word) - 1)")
    roots = words.select("word", "n", F.explode(lengths).alias("m")).withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    level, ready = halved(roots), []
    while True:
        entries = written(level, "entries")
        sizes = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.first("width").alias("w")).where("rows > 1"), "sizes")
        crowded = (F.col("w") > 1) & ((F.col("rows") > limit) | ((F.col("rows") > 2) & (F.col("rows") * F.col("w") > cells)))
        ready.append(entries.join(checked_broadcast(sizes.where(~crowded).select("key")), "key"))
        again = written(sizes.where(crowded).select("key"), "crowded")
        if again.isEmpty():
            break
        level = halved(entries.join(checked_broadcast(again), "key"))
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    return found.select("key", "width", F.expr("substring(word, a + 1, length(word) - a - b)").alias("core"), "word", "n")


# --- the index -----------------------------------------------------------------------------------------


def packed_bits(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    wide = -(-rows.shape[-1] // 64) * 64
    if wide != rows.shape[-1]:
        rows = np.concatenate([rows, np.zeros((*rows.shape[:-1], wide - rows.shape[-1]), bool)], axis=-1)
    return np.packbits(rows, axis=-1, bitorder="little").view(np.uint64)


def near_pairs(cores: list[bytes], width: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y): words x with `width` letters and their near words y in the same block, of as many letters or one more.

    `block` numbers the words' blocks from 0, in order.
    """
    count = len(cores)
    letters = np.frombuffer(b"".join(c.ljust(width + 2, b"\0") for c in cores), np.uint8).reshape(count, width + 2)
    sizes = np.array([len(c) for c in cores])
    asked = np.flatnonzero(sizes == width)
    known, letters = np.unique(letters, return_inverse=True)
    letters = letters.reshape(count, width + 2)
    members = packed_bits(block[None, :] == np.arange(block[-1] + 1)[:, None])
    none = members[block[asked]]  # no error so far
    replaced, longer = np.zeros_like(none), np.zeros_like(none)
    for start in range(0, width, POSITIONS):
        end = min(start + POSITIONS, width)
        index = packed_bits(letters[:, start : end + 1].T[:, None, :] == np.arange(len(known))[None, :, None])
        for i in range(start, end):
            own = letters[asked, i]
            here, next_one = index[i - start, own], index[i + 1 - start, own]
            longer = (longer | none) & next_one
            replaced = (replaced & here) | (none & ~here)
            none = none & here
        if not (none.any() or replaced.any() or longer.any()):
            break
    longer |= none
    found = (replaced & packed_bits((sizes == width)[None, :])) | (longer & packed_bits((sizes == width + 1)[None, :]))
    x, y = np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, count=count, bitorder="little"))
    return asked[x], y


def near_words(members: DataFrame) -> DataFrame:
    """(word, near, near_n): for every word of the blocks its near words; a pair may come from several blocks."""
    names = ["word", "near", "near_n"]

    def walked(table: pa.Table, width: int, key: np.ndarray):
        block = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        cores = [c.encode("latin-1") for c in table.column("core").to_pylist()]
        x, y = near_pairs(cores, width, block)
        back = np.flatnonzero(np.array([len(c) for c in cores])[y] > width)  # words of one letter more ask nothing themselves
        one, two = pa.array(np.r_[x, y[back]]), pa.array(np.r_[y, x[back]])
        columns = [table.column("word").take(one), table.column("word").take(two), table.column("n").take(two)]
        return pa.table(columns, names=names).to_batches()

    def run(batches):
        held: pa.Table | None = None

        def ready(table: pa.Table, last: bool):
            """Whole blocks of one width, TOGETHER words at once if they are small; and what is left."""
            key, width = table.column("key").to_numpy(), table.column("width").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (width[1:] != width[:-1])])
            ends = np.r_[starts[1:], len(key)]
            whole = len(starts) if last else len(starts) - 1
            at = 0
            while at < whole:
                to = at + 1
                most = max(1, min(TOGETHER, (1 << 22) // (int(width[starts[at]]) + 2)))
                while to < whole and ends[to] - starts[at] <= most and width[starts[to]] == width[starts[at]]:
                    to += 1
                low, high = int(starts[at]), int(ends[to - 1])
                yield table.slice(low, high - low), int(width[low]), key[low:high]
                at = to
            return table.slice(int(starts[whole])) if whole < len(starts) else None

        for batch in batches:
            if not len(batch):
                continue
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            parts = ready(held, False)
            while True:
                try:
                    own = next(parts)
                except StopIteration as done:
                    held = done.value
                    break
                yield from walked(*own)
        if held is not None:
            for own in ready(held, True):
                yield from walked(*own)

    dealt = members.repartition("key").sortWithinPartitions("width", "key")
    return dealt.select("key", "width", "core", "word", "n").mapInArrow(run, "word string, near string, near_n long")


# --- forms and roots -----------------------------------------------------------------------------------


def variants(words: DataFrame, factor: int = 2, limit: int = 2048, cells: int = 1 << 24) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of a vocabulary (word, n) of distinct words of letters.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. `form` is the near word
    of the largest n (ties: the smallest in code-point order) if that is at least `factor` (2 or more) times the word's own,
    else null, as is form_n; `root` is where forms end, the word itself without one. `limit` and `cells` (words and letters
    of a block) steer the work, not the result. An empty vocabulary gives an empty table; other columns are ignored.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent, else chains of forms may be circles")
    with scratch(words.sparkSession):
        words = written(words.select("word", F.col("n").cast("long").alias("n")), "words", keep=True)
        pairs = near_words(blocks(words, limit, cells)).groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
        best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), "near")).alias("best"))
        found = words.join(best, "word", "left")
        has = -F.col("best.low") >= factor * F.col("n")
        found = written(
            found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.low")).alias("form_n")),
            "forms", keep=True,
        )
        roots = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots", keep=True)
        while True:
            up = roots.toDF("root", "top")
            step = written(roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots", keep=True)
            roots = step.select("word", "root")
            if step.where("moved").isEmpty():
                break
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def misspelt(run: Column, doc_id: Column, every: int = 97) -> Column:
    """`run`, one letter less where `every` divides the CRC-32 of "<doc_id>:<run>" (a null id is empty): a fixed share of
    occurrences with a known defect."""
    code = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    place = F.pmod(code, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(F.pmod(code, F.lit(every).cast("long")) == 0, cut).otherwise(run)
