"""Language identification by cross-parsing entropy.

For every language a suffix automaton of a bounded sample of labelled text recognises all its substrings. A text is
parsed against each automaton: a phrase is the longest match from the current position, the next phrase starts
after it. A language whose text resembles the sample needs few phrases; phrases x log2(sample length) / text length
is the cross-entropy estimate in bits per symbol, and the language with the least of it wins.

Texts are read whole. Letters are lower-cased, every run of other characters is one space. A text is parsed in
segments of `SEGMENT` symbols, each begun anew, so that numpy parses many segments side by side, one symbol of all
of them at a time; a long text just has more segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import give_back

UNKNOWN = "und"
SEGMENT = 256
#: Symbols parsed side by side at most (a whole text counts as one even if it is longer). Their arrays take some thirty bytes each.
CHUNK = 1 << 20


# --- learning -------------------------------------------------------------------------------------------


def sample_texts(labelled: DataFrame, per_language: int, chars: int, languages: int | None = None) -> dict[str, list[str]]:
    """Up to `per_language` beginnings of `chars` characters for every label, or for the `languages` most frequent.

    `labelled` has id, text, lang. Rows are drawn by a hash of the id; the driver gets at most `per_language` short
    texts for each label.
    """
    usable = labelled.where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("language sample")), F.lit(1 << 30)).cast("double") / (1 << 30)
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first"))
    if languages is not None:
        counts = counts.orderBy(F.desc("n"), "lang").limit(languages)
    drawn = usable.select("lang", F.substring("text", 1, chars).alias("text"), draw.alias("draw"), "id").join(F.broadcast(counts), "lang")
    order = Window.partitionBy("lang").orderBy("draw", "id", "text")
    # Rows of one id are drawn together; a label whose rows share few ids has at least the first of them.
    drawn = drawn.where((F.col("draw") * F.col("n") < 3 * per_language) | (F.col("draw") == F.col("first"))).withColumn("place", F.row_number().over(order))
    texts: dict[str, list[str]] = {}
    for row in drawn.where(F.col("place") <= per_language).select("lang", "text").collect():
        texts.setdefault(row["lang"], []).append(row["text"])
    return texts


def letter_symbols(texts: dict[str, list[str]]) -> np.ndarray:
    """Code point -> symbol: 0 for no letter, 1 to k for the sample's letters, k + 1 for any other letter, which no
    automaton holds."""
    seen: dict[str, int] = {}
    for own in texts.values():
        for text in own:
            for c in text.lower():
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
    known = sorted(sorted(seen), key=lambda c: -seen[c])
    table = np.zeros(0x110000, np.uint16 if len(known) < (1 << 16) - 2 else np.int32)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = len(known) + 1
    table[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
    return table


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols in a row, each text's offsets, and its number of letters. Each text begins and ends with
    a space symbol; runs of them are one."""
    points = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "replace"), np.uint32) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    found = table[np.concatenate(points)] if points else np.zeros(0, table.dtype)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    keep[offsets[:-1]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    found = found[keep]
    offsets = kept[offsets]
    letters = np.concatenate(([0], np.cumsum(found != 0)))
    return found, offsets, letters[offsets[1:]] - letters[offsets[:-1]]


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings of `sequence`; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in sequence:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def packed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, targets, places): state s with symbol c goes to targets[places[s] + c] if owners there is places[s],
    else nowhere. Rows overlap where they have no symbol in common, so the size is that of the transitions, whatever
    the number of letters. All states have places of their own."""
    size = 1 << (4 * sum(map(len, moves)) + len(moves) + width).bit_length()
    while True:
        owners, targets = np.full(size + width, -1, np.int32).tolist(), [0] * (size + width)
        places, taken, at = [-1] * len(moves), bytearray(size), 0
        for s in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
            own = moves[s]
            for _ in range(size):
                at = (at * 1103515245 + 12345) % size  # comes to every place once before it repeats one
                if not taken[at] and all(owners[at + c] < 0 for c in own):
                    break
            else:
                break  # no room: a larger table
            taken[at], places[s] = 1, at
            for c, to in own.items():
                owners[at + c], targets[at + c] = at, to
        else:
            places = np.array(places, np.int32)
            return np.array(owners, np.int32), places[np.array(targets)], places
        size *= 2


def parse_table(texts: list[str], table: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """((owners, targets, starts), log2 of the sample's length). `starts` has the place that a phrase is at after its
    first symbol; for the others see `packed`."""
    width = int(table.max()) + 2  # the last symbol separates sample texts and occurs nowhere else
    found, offsets, _ = symbols(texts, table)
    sequence: list[int] = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        sequence += [*found[a:b].tolist(), width - 1]
    moves = suffix_automaton(sequence)
    # The last state is reached by a symbol that the sample lacks: a phrase of its own, which any symbol ends.
    first, last = moves[0], len(moves)
    inner = [{}, *({c: to for c, to in own.items() if c != width - 1} for own in moves[1:]), {}]
    owners, targets, places = packed(inner, width)
    starts = places[[first.get(c, last) for c in range(width)]]
    return (owners, targets, starts), float(np.log2(max(2, len(sequence))))


def learn(labelled: DataFrame, per_language: int = 96, chars: int = 256, languages: int | None = None) -> dict:
    """The model: all labels (or the `languages` most frequent), symbol table, one parse table and number of letters each.
    Its size for one label is bounded by the other parameters."""
    texts = sample_texts(labelled, per_language, chars, languages)
    names = sorted(texts)
    table = letter_symbols(texts)
    letters = [len({c for t in texts[n] for c in t.lower() if c.isalpha()}) for n in names]
    return {"names": names, "symbols": table, "tables": [parse_table(texts[n], table) for n in names], "letters": letters}


# --- prediction -----------------------------------------------------------------------------------------


def phrase_counts(found: np.ndarray, offsets: np.ndarray, flat: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Phrases of each text, parsed in segments of SEGMENT symbols."""
    lengths = np.diff(offsets)
    pieces = np.maximum(1, -(-lengths // SEGMENT))
    text = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][text] + within * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][text] - start)
    order = np.argsort(-size, kind="stable")
    start, size, text = start[order], size[order], text[order]
    active = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # lanes that have a symbol at each step
    lanes = int(active[0])
    owners, targets, starts = flat
    misses = np.zeros(lanes, np.int32)
    padded = np.concatenate((found, np.zeros(SEGMENT, found.dtype)))
    block = np.lib.stride_tricks.sliding_window_view(padded, SEGMENT)
    columns = np.ascontiguousarray(block[start[:lanes]].T)
    state = starts.take(columns[0])
    for j in range(1, SEGMENT):
        k = int(active[j])
        if not k:
            break
        at = state[:k] + columns[j, :k]
        missed = owners.take(at) != state[:k]
        misses[:k] += missed
        state[:k] = np.where(missed, starts.take(columns[j, :k]), targets.take(at))
    return np.bincount(text[:lanes], weights=misses + 1.0, minlength=len(lengths))


def predicted(texts: list[str], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, scores and bits per symbol of the best label."""
    names = model["names"]
    found, offsets, letters = symbols(texts, model["symbols"])
    n = np.maximum(1, np.diff(offsets))
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits = np.stack([phrase_counts(found, offsets, flat) * log / n for flat, log in model["tables"]])
    best = bits.argmin(axis=0)
    least = bits.min(axis=0)
    score = 1.0 - least / np.partition(bits, 1, axis=0)[1] if len(names) > 1 else np.ones(len(texts))
    some = letters > 0
    labels = [names[i] if ok else UNKNOWN for i, ok in zip(best, some, strict=True)]
    return labels, np.where(some, np.clip(score, 0, 1), 0.0), np.where(some, least, 0.0)


def held_out(id_column: str) -> Column:
    """Whether crc32 of the id's text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits) for every row: the label, how far the second best is behind (0 to 1) and the
    best label's bits per symbol.

    A text that is null, empty or without letters is `und` with score and bits 0, as is every text if nothing was
    learned. Letters the sample lacks cost a phrase each. With one learned label the score is 1. Equal estimates go
    to the label that sorts first. Equal rows all come back; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            values = batch.column(1).to_pylist()
            labels, scores, bits = [], [np.zeros(0)], [np.zeros(0)]
            pool: list[str] = []
            size = 0

            def flush():
                a, b, c = predicted(pool, shared.value)
                labels.extend(a)
                scores.append(b)
                bits.append(c)

            for text in values:
                pool.append(text or "")
                size += len(pool[-1]) + 2
                if size > CHUNK:
                    flush()
                    pool, size = [], 0
            if pool:
                flush()
            yield pa.record_batch(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(bits))],
                names=["id", "lang_pred", "score", "bits"],
            )

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, "id long, lang_pred string, score double, bits double").withColumnRenamed("id", id_column)


#: Letters that are drawn evenly, for `accepted`: all of the sample's up to so many, and a label's own if it has more.
LETTERS = 250


def unknown_share(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The part of each text's letters that the sample lacks; 0 without letters."""
    found, offsets, letters = symbols(texts, table)
    foreign = np.concatenate(([0], np.cumsum(found == table.max())))[offsets]
    return np.diff(foreign) / np.maximum(1, letters)


def accepted(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is known: texts with a letter, of whose letters no more than
    half are missing in the samples, as all are in a text in another script. Texts of 100 characters or more also
    need a parse against their best label in fewer than 1.5 times the bits per symbol that letters drawn evenly take,
    as texts in several of the languages do."""
    names = docs.columns
    at = names.index(text_column)
    known = min(LETTERS, int(model["symbols"].max()))
    most = {n: 1.5 * float(np.log2(max(2, known, k))) for n, k in zip(model["names"], model["letters"], strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep, pool, size = [], [], 0
            for i, text in enumerate(texts):
                pool.append(text)
                size += len(text) + 2
                if size > CHUNK or i == len(texts) - 1:
                    labels, _, bits = predicted(pool, shared.value)
                    foreign = unknown_share(pool, shared.value["symbols"])
                    keep += [x != UNKNOWN and u <= 0.5 and (len(t) < 100 or b < most[x]) for x, b, u, t in zip(labels, bits, foreign, pool, strict=True)]
                    pool, size = [], 0
            yield batch.filter(pa.array(keep, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)


def language_model(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **bounds) -> dict:
    """Learn from the rows of `docs` that are not held out. Rows without id, text or label are not learned from."""
    rows = docs.where(~held_out(id_column)).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    return learn(rows, **bounds)
