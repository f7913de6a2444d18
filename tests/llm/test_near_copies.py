"""Operators that compare texts: Jaccard join, suffix dedup, decontamination, components."""

import random

import numpy as np
import pytest
from brute import EXTRA, HARD, PASSAGE, hard_docs, leaks, plain_docs, repeats, similar_groups, texts
from conftest import SMALL
from pyspark.sql import functions as F

from gaugeworks.llm import common, decontaminate, ngram_join, suffix_dedup


def family(n, words=120, seed=0):
    """Copies of one text with words changed, so that only some are links, and a passage in unrelated texts."""
    pick = random.Random(seed)
    base = [f"w{pick.randrange(500)}" for _ in range(words)]
    rows = [(100, " ".join(base)), (101, " ".join(base).upper())]
    for i in range(n):
        own = list(base)
        for _ in range(pick.randrange(8)):
            own[pick.randrange(words)] = f"changed{pick.randrange(10**6)}"
        rows.append((200 + i, " ".join(own)))
    for i in range(n):
        filler = " ".join(f"f{pick.randrange(10**6)}" for _ in range(pick.randrange(5, 60)))
        rows.append((2000 + i, f"{filler} {PASSAGE} {filler}"))
    return rows


def groups(found):
    """component ids of the rows, in order of (id, size)."""
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())


def expected(rows):
    own, sizes = similar_groups(rows)
    low = {}
    for (i, _), g in zip(rows, own, strict=True):
        low[g] = min(low.get(g, i), i)
    return sorted((i, n, low[g]) for (i, _), g, n in zip(rows, own, sizes, strict=True))


def test_components_equal_brute_force(spark):
    rows = family(60) + texts(spark, SMALL)
    rows = [(1000 * k + (i % 1000) + 10_000 * (i >= 1000), t) for k, (i, t) in enumerate(rows)]  # distinct ids
    for short in (2, 16, 10**6):  # with centres in all lists, as usual, in none
        assert groups(ngram_join.jaccard_components(plain_docs(spark, rows), short=short)) == expected(rows)


def test_hard_rows_of_the_join(spark):
    found = ngram_join.jaccard_components(hard_docs(spark)).collect()
    assert len(found) == len(HARD)
    by = {r.doc_id: r for r in found if r.doc_id not in (None, 9)}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert [by[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[4].component_id == by[5].component_id == 4 and by[4].n_shingles == 1
    assert by[7].component_id == by[8].component_id == 7
    nobody = [r for r in found if r.doc_id is None]
    assert sorted(r.component_id or -1 for r in nobody) == [-1, 7]


def test_empty_tables(spark):
    none = hard_docs(spark, [])
    assert ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.one_of_each(none).count() == 0
    assert suffix_dedup.repeated_passages(none).count() == 0
    assert decontaminate.clean(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = hard_docs(spark)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None)
    assert [i for i, _ in ids].count(7) == 1
    assert not {5, 8} & {i for i, _ in ids}
    assert {1, 2, 3, 4} <= {i for i, _ in ids}
    assert sum(i == 9 for i, _ in ids) == 1  # the upper-case copy went, the other text stayed


def test_sketches_never_overstate_the_difference():
    pick = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(pick.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: pick.integers(0, 200)], pick.integers(0, 2**63, 60, dtype=np.uint64))))
        words = [np.frombuffer(ngram_join.sketch(x), np.uint64)[None, :] for x in (a, b)]
        assert ngram_join.differ(*words)[0] <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    pick = random.Random(3)
    nodes = [pick.getrandbits(60) for _ in range(300)]
    chain = list(zip(nodes[:100], nodes[1:101], strict=True))
    star = [(nodes[150], x) for x in nodes[151:250]]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert {found[x] for x in nodes[:101]} == {min(nodes[:101])}
    assert {found[x] for x in nodes[150:250]} == {min(nodes[150:250])}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_of_threads_are_apart(spark):
    """A block that ends in one thread leaves the tables of another one."""
    import threading

    inside, ended = threading.Event(), threading.Event()

    def other():
        with common.scratch(spark):
            inside.wait(60)
            common.written(spark.range(2), "other")
        ended.set()

    thread = threading.Thread(target=other)
    thread.start()
    with common.scratch(spark):
        mine = common.written(spark.range(3), "mine")
        inside.set()
        assert ended.wait(60) and mine.count() == 3
    thread.join()


def test_most_frequent_rows_are_bounded_without_a_sort(spark):
    counts = spark.range(1, 1001).selectExpr("id AS key", "id AS n")
    found = common.most_frequent(counts, 10, 200)
    kept = sorted(r.n for r in found.collect())
    assert 100 < len(kept) <= 200 and kept == list(range(kept[0], 1001))
    assert common.most_frequent(counts, 995, 200).count() == 6 and common.most_frequent(counts, 5000, 9).count() == 0
    assert "Sort" not in found._jdf.queryExecution().executedPlan().toString()


def test_word_hashes_are_the_words(spark):
    import pyarrow as pa

    rows = ["a b", None, "", "b  a\tb", "x" * (common.CHUNK + 5) + " a", "é a"]
    got = {}
    for first, words, offsets in common.hashed_words(pa.array(rows), lower=False):
        for i in range(len(offsets) - 1):
            got[first + i] = words[offsets[i] : offsets[i + 1]].tolist()
    a, b = got[0]
    assert got[1] == got[2] == [] and got[3] == [b, a, b] and got[4][1] == a and got[5][1] == a
    assert len({a, b, got[4][0], got[5][0]}) == 4


def test_passages_equal_brute_force(spark):
    rows = [(i, t) for i, t in HARD if i is not None and i not in (7, 9)] + [(1000 + i, t) for i, t in texts(spark, SMALL)]
    found = suffix_dedup.repeated_passages(plain_docs(spark, rows)).collect()
    assert {tuple(r) for r in found} == repeats(rows)
    assert {13, 14} <= {r.doc_id for r in found}


def test_hard_rows_of_the_passages(spark):
    found = suffix_dedup.repeated_passages(hard_docs(spark)).collect()
    assert {7, 8, None, 11, 13, 14} <= {r.doc_id for r in found}
    assert not {1, 2, 3, 4, 5, 6, 10} & {r.doc_id for r in found}


def test_frequent_grams_are_dealt_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "DEALT", 5)
    rows = [(i, f"{' '.join(f'x{i}y{j}' for j in range(30))} {PASSAGE} {i}") for i in range(80)]
    found = suffix_dedup.repeated_passages(plain_docs(spark, rows)).collect()
    assert {tuple(r) for r in found} == {(i, 30, 60) for i in range(80)}


def test_rows_that_share_parts_hide_no_passage(spark):
    rows, n = [], 0
    for p in range(12):
        words = [f"passage{p}w{j}" for j in range(50)]
        for part in [words, words, *(words[k:] for k in range(1, 26)), *(words[:-k] for k in range(1, 26))]:
            own = [f"own{n}w{j}" for j in range(60)]
            rows.append((n, " ".join(own[:30] + part + own[30:])))
            n += 1
    found = suffix_dedup.repeated_passages(plain_docs(spark, rows)).collect()
    assert {tuple(r) for r in found} == repeats(rows)
    assert {(52 * p + i, 30, 50) for p in range(12) for i in (0, 1)} <= repeats(rows)


def test_two_rows_around_a_frequent_gram_meet(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "DEALT", 5)
    licence = " ".join(f"licence{i}" for i in range(46))
    own = lambda i, side: " ".join(f"{side}{i}w{j}" for j in range(30))
    rows = [(i, f"{own(i, 'before')} {licence} {own(i, 'after')}") for i in range(300)]
    more = " ".join(f"more{j}" for j in range(6))
    rows += [(i, f"{own(i, 'before')} {licence} {more} {own(i, 'after')}") for i in (300, 301)]
    rows += [(i, f"{own(i, 'before')} {more} {licence} {own(i, 'after')}") for i in (302, 303)]
    found = suffix_dedup.repeated_passages(plain_docs(spark, rows)).collect()
    assert {tuple(r) for r in found} == repeats(rows) == {(i, 30, 52) for i in range(300, 304)}


def test_minimisers_cover_every_window():
    pick = np.random.default_rng(5)
    for n in (10, 26, 27, 200):
        hashes = pick.integers(0, 50, n, dtype=np.uint64)
        chosen = set(suffix_dedup.minimisers(hashes, 26).tolist())
        for start in range(n - 25):
            window = hashes[start : start + 26]
            assert chosen & {start + int(k) for k in np.flatnonzero(window == window.min())}


@pytest.fixture(scope="module")
def benchmark_rows(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]


def test_leaks_equal_brute_force(spark, benchmark_rows):
    rows = texts(spark, SMALL)
    words = benchmark_rows[0][1].split()
    rows += [
        (5001, " ".join(words)), (5002, "see " + " ".join(words).upper() + " there"), (5003, " ".join(words[2:])),
        (5004, " ".join(words[: len(words) // 2])), (5005, " ".join([*words[:4], "odd", *words[5:]])), (5006, None), (5007, ""),
    ]
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    found = decontaminate.contaminated(plain_docs(spark, rows), items).collect()
    want = leaks(rows, benchmark_rows)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in want.items()}
    assert {5001, 5002, 5003} <= {d for d, _ in want} and not {5004, 5006, 5007} & {d for d, _ in want}


def test_rearranged_passages_are_found(spark):
    """Windows start anywhere: the item's halves changed places, so that no shingle lies where the item has it."""
    pick = random.Random(3)
    words = lambda n: [f"w{pick.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(100), words(100), words(60)
    items = [(1, " ".join(a + b)), (2, " ".join(c)), (3, " ".join(c)), (4, " ".join(c[:30] * 2))]
    rows = [
        (10, " ".join(words(300) + b + a + words(300))), (11, " ".join(b + a)), (12, " ".join(a + words(200) + b)),
        (13, " ".join(words(40) + c[30:] + c[:30] + words(5))), (14, " ".join(c[:50])), (15, " ".join(c * 3)), (16, " ".join(words(400))),
        (17, " ".join(words(9) + c[:20] + words(2) + c[20:40] + words(2) + c[40:] + words(9))), (18, " ".join(c[:30] * 5)),
    ]
    found = decontaminate.contaminated(plain_docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = leaks(rows, items)
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in found} == want
    assert (10, 1) in want and want[10, 1] > 0.95 and (12, 1) not in want and {(13, 2), (13, 3), (15, 2), (18, 4)} <= set(want)
    first = {(r.doc_id, r.item_id): r.first_word for r in found}
    assert first[10, 1] == 300 and first[11, 1] == 0 and first[15, 2] == 0


def test_items_in_question_stay_few(spark):
    """Many items of one length that share boilerplate: a window asks for those with a rare shingle of it."""
    pick = random.Random(5)
    common = [f"common{i}" for i in range(30)]
    items = [(i, " ".join(common + [f"w{pick.randrange(10**7)}" for _ in range(30)])) for i in range(2000)]
    keys = spark.createDataFrame(items, "item_id long, text string")
    own = keys.select(F.col("item_id").alias("key"), decontaminate.shingles(F.col("text"), 5).alias("own"))
    counts = own.select("key", F.size("own").alias("length"), F.explode("own").alias("hash")).groupBy("key", "length", "hash").count().withColumnRenamed("count", "n")
    lists = decontaminate.rarest(counts, 0.8).groupBy("hash").count()
    assert lists.agg(F.max("count")).first()[0] < 0.01 * len(items)
    docs = plain_docs(spark, [(1, items[77][1] + " tail"), (2, " ".join(common * 3))])
    found = decontaminate.contaminated(docs, keys).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in found] == [(1, 77, 1.0)]


def test_hard_rows_and_items_of_decontamination(spark):
    items = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, "one two"), (None, "long " * 8)], "item_id long, text string")
    docs = hard_docs(spark)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(13, 1), (13, 2), (14, 1), (14, 2), (11, None)}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and set(EXTRA) <= set(kept.columns)
    assert kept.count() == len(HARD) - 3
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, no_items).count() == len(HARD)


def test_blocks_find_every_pair_within_the_radius(spark):
    """Random fingerprints at all distances up to the radius share a probed block value."""
    pick = random.Random(9)
    near = 23 // decontaminate.BLOCKS
    for _ in range(300):
        a, bits = pick.getrandbits(64), pick.sample(range(64), pick.randrange(24))
        b = a
        for bit in bits:
            b ^= 1 << bit
        assert any(bin((a ^ b) >> 8 * i & 255).count("1") <= near for i in range(8))


def test_decontamination_uses_no_python(spark, benchmark_rows):
    items = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    plan = decontaminate.contaminated(plain_docs(spark, [(1, "a b c d e f")]), items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
