"""Quality rules: base statistics and a calibrated logistic regression over hashed word and character n-grams.

Features are relative frequencies of hashed words, word pairs (both lower case) and character triples (as written) in
the whole text, so a score is a bias plus three mean weights: per batch, hashes and weights are numpy arrays and texts
are told apart by running sums. The regression is trained on a bounded sample of labelled rows; a part of the sample is
kept from training and calibrates the probabilities. Thresholds are fixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import hashed_words, rolling_hashes, sliced, text_bytes

#: Each of the three kinds of features has 2 ** BITS weights.
BITS = 16
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


# --- whole texts as numbers -----------------------------------------------------------------------------


def gathered(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]; 0 where that is empty."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    ends = np.maximum(starts, ends)
    return total[ends] - total[starts]


def character_triples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the three code points from each on, and each text's offsets among code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if len(points) < 3:
        return np.zeros(0, np.int64), begins[offsets]
    mixed = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) + points[2:] * np.uint32(0xC2B2AE3D)
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)).astype(np.int64), begins[offsets]


def features(column: pa.Array):
    """Yield (first row, [(hashes, starts, ends) of words, word pairs, character triples]) for chunks of texts."""
    data, offsets = text_bytes(column)
    for first, words, bounds in hashed_words(column, lower=True):
        rows = len(bounds) - 1
        own = offsets[first : first + rows + 1]
        triples, marks = character_triples(data[own[0] : own[-1]], own - own[0])
        pairs = rolling_hashes(words, 2)
        short = lambda x: (x >> np.uint64(64 - BITS)).astype(np.int64)
        yield first, [
            (short(words), bounds[:-1], bounds[1:]),
            (short(pairs), bounds[:-1], bounds[1:] - 1),
            (triples, marks[:-1], marks[1:] - 2),
        ]


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    windows = rolling_hashes(hashes, 3)
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    inside = np.zeros(len(hashes), bool)
    at = np.flatnonzero(np.isin(windows, again))
    for i in range(3):
        inside[at + i] = True
    return int(inside.sum())


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def base_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = text_bytes(column)
    symbol, gap = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    gap[[9, 10, 11, 12, 13, 32]] = True
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    n = len(offsets) - 1
    words, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for first, hashes, bounds in hashed_words(column, lower=False):
        words[first : first + len(bounds) - 1] = np.diff(bounds)
        for i in np.flatnonzero(np.diff(bounds) > 3).tolist():
            repeats[first + i] = repeated_words(hashes[bounds[i] : bounds[i + 1]])
    return {
        "n_words": words,
        "word_chars": count(((data & 0xC0) != 0x80) & ~gap[data]),
        "n_symbols": count(symbol[data]),
        "n_dup_lines": np.array([repeated_lines(t) for t in column.to_pylist()], np.int64),
        "n_repeat_words": repeats,
    }


# --- training -------------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, most: int) -> DataFrame:
    """(id, text, label): up to `most` labelled ids, drawn by a hash of the id, one row each: that of the smallest text hash,
    however many rows have the id. The label is 0 or 1."""
    ids, label = F.col(id_column), F.col(label_column)
    drawn = labels.where(ids.isNotNull() & label.isin(0, 1)).groupBy(ids.alias("id")).agg(F.max(label).alias("label"))
    drawn = drawn.orderBy(F.xxhash64(F.col("id"), F.lit("quality sample")), "id").limit(most)
    texts = docs.where(F.col(text_column).isNotNull()).select(ids.alias("id"), F.col(text_column).alias("text"))
    return one_text_each(texts.join(F.broadcast(drawn), "id"))


def one_text_each(sample: DataFrame) -> DataFrame:
    """(id, text, label) with one row of each id, chosen before the shuffle as well."""
    best = F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text"), F.col("label"))).alias("best")
    return sample.groupBy("id").agg(best).select("id", "best.text", "best.label")


def sparse_rows(sample: DataFrame) -> DataFrame:
    """(id, label, feature, value): each text's relative frequencies, as arrays."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            for first, kinds in features(batch.column("text")):
                for row in range(len(kinds[0][1])):
                    found, shares = [], []
                    for kind, (hashes, starts, ends) in enumerate(kinds):
                        own = hashes[starts[row] : max(starts[row], ends[row])]
                        values, counts = np.unique(own, return_counts=True)
                        found.append(values + (kind << BITS))
                        shares.append(counts / max(1, len(own)))
                    out.append((ids[first + row], labels[first + row], np.concatenate(found), np.concatenate(shares)))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch(columns, names=["id", "label", "feature", "value"])

    return sample.select("id", "label", "text").mapInArrow(run, "id long, label int, feature array<int>, value array<float>")


def train(rows, rounds: int = 120, rate: float = 0.5, decay: float = 1e-6) -> dict:
    """Weights by full-batch AdaGrad on four fifths of the rows, then Platt scaling on the rest.

    `rows` is an Arrow table of `sparse_rows`. Without rows of both labels the model says 1/2 for every text.
    """
    weights = np.zeros(3 << BITS)
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    label = rows.column("label").to_numpy()[order].astype(np.float64)
    if not len(order) or label.min() == label.max():
        return {"weights": weights.astype(np.float32), "bias": 0.0, "slope": 1.0, "shift": 0.0}
    rows = rows.take(pa.array(order)).combine_chunks()
    feature, value = rows.column("feature").combine_chunks(), rows.column("value").combine_chunks()
    size = feature.value_lengths().to_numpy().astype(np.int64)
    feature, value = feature.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    score = lambda w, b: np.bincount(row, weights=value * w[feature], minlength=len(size)) + b
    learn = np.arange(len(size)) % 5 != 0
    bias, seen, seen_bias = 0.0, np.full(3 << BITS, 1e-12), 1e-12
    for _ in range(rounds):
        error = np.where(learn, 1 / (1 + np.exp(-score(weights, bias))) - label, 0.0) / learn.sum()
        slope = np.bincount(feature, weights=value * error[row], minlength=3 << BITS) + decay * weights
        seen += slope**2
        seen_bias += error.sum() ** 2
        weights -= rate * slope / np.sqrt(seen)
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    slope, shift = platt(score(weights, bias)[~learn], label[~learn])
    return {"weights": weights.astype(np.float32), "bias": float(bias), "slope": slope, "shift": shift}


def platt(score: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a x score + b))) fits the labels, which are softened for small samples."""
    good = label.sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        found -= np.clip(step, -2, 2)
    return float(found[0]), float(found[1])


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    most: int = 3000,
) -> dict:
    """A model from at most `most` labelled rows (label 1: good). Null ids, texts and other labels are left out."""
    return train(sparse_rows(labelled_sample(docs, labels, id_column, text_column, label_column, most)).toArrow())


# --- scoring --------------------------------------------------------------------------------------------


def probabilities(column: pa.Array, model: dict) -> np.ndarray:
    out = np.zeros(len(column))
    for first, kinds in features(column):
        score = np.full(len(kinds[0][1]), model["bias"])
        for kind, (hashes, starts, ends) in enumerate(kinds):
            sums = gathered(model["weights"][hashes + (kind << BITS)].astype(np.float64), starts, ends)
            score += sums / np.maximum(1, ends - starts)
        out[first : first + len(score)] = score
    return 1 / (1 + np.exp(-np.clip(model["slope"] * out + model["shift"], -30, 30)))


def judged(
    docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good) for every row.

    Words are runs of anything but space and the characters 9 to 13. base_failed: fewer than 50 words, or more than half
    of the words lie in three-word windows that occur again. kept: not base_failed and p_good >= `threshold`. Null and
    empty texts have no words. Equal rows and null ids all come back; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            parts = [(base_statistics(x), probabilities(x, shared.value)) for x in sliced(texts)]
            if not parts:
                continue
            base = {k: np.concatenate([b[k] for b, _ in parts]) for k in parts[0][0]}
            p = np.concatenate([x for _, x in parts])
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
            columns = [ids, *[pa.array(x, pa.int64()) for x in base.values()], pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
            yield pa.record_batch(columns, names=["id", *base, "base_failed", "kept", "p_good"])

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_column)
