"""Plain Python versions of what the text operators compute, and rows that are hard on them."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
#: (doc_id, text): nulls, empty, blank and very long texts, ties, repeated rows and ids.
HARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, "!!! ... ???"), (7, PROSE), (7, PROSE),
    (8, PROSE + " end"), (9, PROSE.upper()), (9, "another text under the same id"), (None, PROSE + " nobody"), (None, None),
    (10, "a" * 30_000), (11, "long " * 20_000), (12, "é ß 漢字 \U0001f600 " * 40), (13, f"before {PASSAGE} after"),
    (14, f"other words {PASSAGE} and more"), (15, "7" * 3000 + " +" * 3000 + "@" * 3000 + ".1" * 3000), (16, "x\x00y\x85z w v"),
]
#: Names that the operators use themselves.
EXTRA = ("id", "text_key", "key", "n", "part", "row", "token", "start", "host", "cuts", "gram", "word")


def hard_docs(spark, rows=HARD):
    columns = ", ".join(f"`{c}` string" for c in EXTRA)
    data = [(i, t, "en", "src", None if t is None else len(t), *["x"] * len(EXTRA)) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {columns}")


def plain_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def shingles(text, size=5):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def similar_groups(rows, percent=80):
    """Index of each row's group: rows linked by Jaccard similarity."""
    sets = [shingles(t) for _, t in rows]
    holders: dict = {}
    for i, own in enumerate(sets):
        for s in own:
            holders.setdefault(s, []).append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in enumerate(sets):
        for j, both in Counter(j for s in own for j in holders[s] if j < i).items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 16 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def redact(text):
    spans = sorted((a, b, k) for k, a, b in personal(text))
    merged = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in reversed(merged):
        text = f"{text[:a]}[{k.upper()}]{text[b:]}"
    return text


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def leaks(rows, items, size=5):
    """(doc, item) -> best similarity over all windows of the item's length, by counts of shingles."""
    token = re.compile(r"[^\W_]+")
    runs = lambda t: (lambda w: [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])(token.findall((t or "").lower()))
    out: dict = {}
    wanted = [(i, runs(t)) for i, t in items]
    for doc, text in rows:
        own = runs(text)
        for item, sought in wanted:
            if not sought or not set(own) & set(sought):
                continue
            need = Counter(sought)
            for start in range(max(1, len(own) - len(sought) + 1)):
                window = own[start : start + len(sought)]
                both = sum((Counter(window) & need).values())
                value = both / (len(window) + len(sought) - both)
                if value >= 0.8:
                    out[doc, item] = max(value, out.get((doc, item), 0))
    return out


def repeats(rows, least=50):
    """Stretches of words that lie in some run of `least` words that occurs twice."""
    words = {(i, t): WORD.findall(t) for i, t in rows if t}
    seen = Counter(tuple(w[k : k + least]) for i, t in rows if t for w in [words[i, t]] for k in range(len(w) - least + 1))
    out = set()
    for (i, _), w in words.items():
        run = None
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                if run and k <= run[1]:
                    run[1] = k + least
                else:
                    if run:
                        out.add((i, run[0], run[1] - run[0]))
                    run = [k, k + least]
        if run:
            out.add((i, run[0], run[1] - run[0]))
    return out


def base_quality(text):
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    counts = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside), failed
