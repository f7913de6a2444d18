"""Golay-code near copies, spelling variants and hard negatives against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute import EXTRA, HARD, LOW, WORD, hard_docs, plain_docs, texts
from conftest import SMALL
from pyspark.sql import functions as F

from gaugeworks.llm import golay_copies, hard_negatives, spelling

# --- Golay-code near copies ----------------------------------------------------------------------------


def fingerprint(text, size=3):
    words = WORD.findall((text or "").translate(LOW))
    runs = [words[i : i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    ones = Counter()
    for run in runs:
        h = xxhash.xxh64_intdigest(" ".join(run).encode(), 42)
        ones.update(bit for bit in range(64) if h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(runs))


def lowest_linked(nodes):
    """{print: smallest print reachable by links of two bits or fewer}."""
    nodes = sorted(nodes)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in nodes}


def expected_copies(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = lowest_linked(set(prints))
    low = defaultdict(list)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            low[root[p]].append(i)
    return sorted(((i is None, i or 0), p, min(low[root[p]], default=None)) for (i, _), p in zip(rows, prints, strict=True))


def found_copies(frame):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint & (1 << 64) - 1, r.component_id) for r in frame.collect())


def edited(n, words=150, seed=5):
    pick = random.Random(seed)
    base = [f"w{pick.randrange(900)}" for _ in range(words)]
    for i in range(n):
        own = list(base)
        for _ in range(pick.randrange(4)):
            own[pick.randrange(words)] = f"changed{pick.randrange(9)}"
        yield 5000 + i, " ".join(own)


@pytest.mark.parametrize("crowd", [1, 32])
def test_components_of_fingerprints_equal_brute_force(spark, crowd):
    rows = texts(spark, SMALL) + list(edited(150)) + [(i, t) for i, t in HARD if i is not None]
    found = golay_copies.near_copies(plain_docs(spark, rows), crowd=crowd)
    assert found_copies(found) == expected_copies(rows)


def test_hard_rows_of_fingerprints(spark):
    assert found_copies(golay_copies.near_copies(hard_docs(spark))) == expected_copies(HARD)
    assert golay_copies.near_copies(hard_docs(spark, [])).count() == 0
    only_null = golay_copies.near_copies(hard_docs(spark, [(None, "a b c d"), (None, "a b c d")])).collect()
    assert [r.component_id for r in only_null] == [None, None]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 37}x{i % 11}" for i in range(500)) + "\n"
    whole = [h.tolist() for h in golay_copies.shingle_hashes(text.encode(), 3)]
    monkeypatch.setattr(golay_copies, "CHUNK", 64)
    cut = [h.tolist() for h in golay_copies.shingle_hashes(text.encode(), 3)]
    assert len(cut) > 10 and sum(cut, []) == sum(whole, [])


def test_golay_keys_meet_within_two_errors():
    tables = golay_copies.golay_tables()
    assert sorted(Counter(tables[2].tolist()).items()) == [(1, 2325), (6, 1771)]  # the code's covering by one or six
    pick = random.Random(1)
    for _ in range(300):
        x = pick.getrandbits(64)
        for errors in (0, 1, 2):
            y = x
            for bit in pick.sample(range(64), errors):
                y ^= 1 << bit
            row, key = golay_copies.fuzzy_keys(np.array([x, y], np.uint64), tables)
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())
    many = np.array([pick.getrandbits(64) for _ in range(20_000)], np.uint64)
    row, key = golay_copies.fuzzy_keys(many, tables)
    assert 15 < len(key) / len(many) < 22 and len(np.unique(key)) > 0.99 * len(key)  # keys part what is unrelated


@pytest.mark.parametrize("crowd", [1, 8, 10**6])
def test_crowded_keys_link_as_pairs_do(spark, crowd):
    """A ball of fingerprints around one: hot keys take the linear way and keep every component."""
    pick = random.Random(8)
    centre = pick.getrandbits(64)
    prints = {centre}
    for _ in range(600):
        own = centre
        for bit in pick.sample(range(64), pick.randrange(1, 7)):
            own ^= 1 << bit
        prints.add(own)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    rows = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = {r.fingerprint & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in golay_copies.labelled(rows, crowd).collect()}
    wanted = lowest_linked(prints)
    same = defaultdict(set)
    for x in prints:
        same[wanted[x]].add(found[x])
    assert all(len(s) == 1 for s in same.values()) and len(set(found.values())) == len(same)


def test_one_of_each_group_of_fingerprints_stays(spark):
    docs = hard_docs(spark)
    kept = golay_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    by = {(r.doc_id, r.text) for r in kept.collect()}
    roots = lowest_linked({fingerprint(t) for _, t in HARD})
    assert len(by) == len({roots[fingerprint(t)] for _, t in HARD})
    assert (1, None) in by and (5, "one two") not in by and (4, "one two") in by


# --- spelling variants ---------------------------------------------------------------------------------

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def is_near(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def expected_variants(counts, factor=2):
    """By deleting letters of all words: independent of blocks and bits."""
    sieve = defaultdict(set)
    for w in counts:
        sieve[w].add(w)
        for i in range(len(w)):
            sieve[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for own in sieve.values():
        for x in own:
            near[x].update(y for y in own if is_near(x, y))
    form = {}
    for w, n in counts.items():
        best = min(((-counts[x], x.encode()) for x in near[w]), default=None)
        if best and -best[0] >= factor * n:
            form[w] = best[1].decode()
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def found_variants(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def occurrences(rows):
    counts = Counter()
    for i, t in rows:
        for run in LETTERS.findall(t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def of_docs(docs):
    runs = spelling.runs(docs)
    return spelling.variants(spelling.vocabulary(runs, spelling.misspelt(F.col("run"), F.col("doc_id"))))


def test_variants_of_documents_equal_brute_force(spark):
    rows = texts(spark, SMALL)
    expected = expected_variants(occurrences(rows))
    assert found_variants(of_docs(plain_docs(spark, rows))) == expected
    assert sum(r[1] is not None for r in expected) > 10


def test_hard_rows_of_variants(spark):
    rows = HARD + [(30, "größe Größe GROSSE größe grösse " * 3), (31, "aaaaaa aaaaaa aaaaaa aaaaa aaaaa aaaaa aaaaaab " * 3), (32, "x" * 70_000 + " " + "x" * 69_999 + "y " + "x" * 70_001)] * 3
    rows = rows[:]
    expected = expected_variants(occurrences([r for r in rows if r[0] not in (10, 32)]))
    found = found_variants(of_docs(hard_docs(spark, rows)))
    assert [r for r in found if len(r[0]) < 1000] == [r for r in expected if len(r[0]) < 1000]
    assert of_docs(hard_docs(spark, [])).count() == 0 and of_docs(hard_docs(spark, [(1, None), (2, "12 ! 3")])).count() == 0


def test_long_words_meet(spark):
    base = "ab" * 20_000
    words = {base: 9, base + "c": 4, "c" + base[1:]: 3, base[:20_000] + "z" + base[20_000:]: 3, base[1:-1]: 50}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    by = {w: (f, k) for w, f, _, _, k, _ in found_variants(spelling.variants(frame))}
    assert by[base] == (None, 3) and by[base + "c"] == (base, 1) and by["c" + base[1:]] == (base, 1) and by[base[1:-1]] == (None, 0)


@pytest.mark.parametrize("limit", [2, 7, 100_000])
def test_blocks_cut_again_lose_nothing(spark, limit):
    """Words that share beginnings, ends and letters; tiny blocks are halved down to one letter."""
    pick = random.Random(limit)
    words = {}
    for _ in range(1500):
        stem = pick.choice(["common", "beginning", "abcab"])
        own = stem + "".join(pick.choice("abé") for _ in range(pick.randrange(5))) + pick.choice(["ending", "ab", ""])
        words[own] = pick.randrange(3, 400)
    words = {w: n for w, n in words.items() if len(w) >= 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found_variants(spelling.variants(frame, limit=limit)) == expected_variants(words)
    assert found_variants(spelling.variants(frame, factor=5, cells=40)) == expected_variants(words, 5)


def test_forms_must_be_twice_as_frequent(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), factor=1)


# --- hard negatives ------------------------------------------------------------------------------------


def expected_negatives(rows, positives=5, negatives=5, every=100):
    known = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = (label, [int(np.floor(256 * float(x))) for x in v])
        known[i] = min(known.get(i, own), own)
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in known.items() if i != a)
        for s, p in [x for x in scored if known[x[1]][0] == label][:positives]:
            fits = [(i, -t) for t, i in scored if known[i][0] != label and 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(a, p, r, i, -s, t) for r, (i, t) in enumerate(fits, 1)]
    return sorted(out)


def found_negatives(frame):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in frame.collect())


def clustered(n, dims=12, labels=4, seed=2):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(labels, dims))
    return [(i, int(k := pick.integers(labels)), [float(np.float32(x)) for x in centres[k] * (0.3 + 0.7 * (i % 3 == 0)) + pick.normal(size=dims) * 0.4]) for i in range(n)]


def vectors(spark, rows):
    extra = ", ".join(f"`{c}` string" for c in (*EXTRA, "vector", "score", "window", "group", "rank_"))
    data = [(i, label, v, *["x"] * (len(EXTRA) + 5)) for i, label, v in rows]
    return spark.createDataFrame(data, f"vec_id long, label int, embedding array<float>, {extra}")


@pytest.mark.parametrize(("block", "group", "shards"), [(8192, 256, 64), (17, 3, 2)])
def test_negatives_equal_brute_force(spark, block, group, shards):
    rows = clustered(700)
    rows += [(700 + i, 1, rows[4][2]) for i in range(40)] + [(5, 0, rows[9][2]), (5, 0, rows[9][2])]  # ties and repeated ids
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, rows[0][2]), (1000, 1, None), (1100, 1, [1.0, nan]), (1200, 2, [inf, 1.0]), (None, 1, rows[0][2]), (1300, 1, [None, 1.0]), (1400, 2, []), (1500, 1, [0.5])]
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("id") % 20 == 0, block=block, group=group, shards=shards)
    expected = expected_negatives(rows, every=20)
    assert len(expected) > 100 and found_negatives(found) == expected


def test_empty_tables_and_anchors_without_others(spark):
    is_anchor = F.col("id") % 100 == 0
    assert hard_negatives.hard_negatives(vectors(spark, []), is_anchor).count() == 0
    assert hard_negatives.hard_negatives(vectors(spark, [(100, 1, [1.0])]), is_anchor).count() == 0
    two = [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]
    assert found_negatives(hard_negatives.hard_negatives(vectors(spark, two), is_anchor)) == [(100, 1, 1, 2, 65536, 58880)]


def test_large_components_are_exact(spark):
    big = float(1 << 22)
    rows = [(100, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 2, [big, 2.0]), (3, 2, [big, 2.5]), (4, 2, [big, 3.5])]
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("id") % 100 == 0)
    assert found_negatives(found) == expected_negatives(rows) and len(expected_negatives(rows)) == 2


def group_of(vectors_, labels, windows):
    import pyarrow as pa

    ids = np.arange(len(vectors_), dtype=np.int64)
    row = hard_negatives.packed(ids, np.array(labels, np.int64), pa.array(vectors_, pa.list_(pa.int64())))
    found = dict(zip(("id", "label", "vector", "dim", "kind", "rows"), row, strict=True))
    return found | {"spans": np.array(windows, np.int64).tobytes(), "taken": np.ones(len(vectors_), np.int64).tobytes()}


def test_bounds_spare_most_scores():
    """Anchors in tight groups: rows far from a window of a child are never scored."""
    pick = np.random.default_rng(0)
    centre = pick.normal(size=16) * 256
    anchors = [[int(x) for x in centre + pick.normal(size=16) * 4] for _ in range(50)]
    rows = [[int(x) for x in pick.normal(size=16) * 256] for _ in range(3000)]
    high = int(np.dot(anchors[0], anchors[0]))
    search = hard_negatives.Search(group_of(anchors, [0] * 50, [(high * 8 // 10, high)] * 50), False, 5)
    search.show(group_of(rows, [1] * 3000, [(0, 0)] * 3000))
    assert search.met == 50 * 3000 and search.scored < 0.1 * search.met
    order, parent, edge = hard_negatives.spanning_tree(np.array(anchors, float))
    assert sorted(order.tolist()) == list(range(50)) and (parent >= 0).sum() == 49
    place = {int(k): i for i, k in enumerate(order)}
    assert all(place[int(parent[k])] < place[k] for k in range(50) if parent[k] >= 0)
