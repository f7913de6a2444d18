"""Language, quality rules and site quality."""

import random

import numpy as np
import pyarrow as pa
from brute import HARD, base_quality, hard_docs, plain_docs, texts
from conftest import SMALL
from pyspark.sql import functions as F

from gaugeworks.llm import language, quality_rules, quality_sites

MIDDLE = "/root/testdata/sf0.01"


def phrases(text, sample):
    """Longest matches, one after another."""
    count, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def test_parse_equals_longest_matches():
    pick = random.Random(2)
    sample = ["".join(pick.choice("abc ") for _ in range(60)) for _ in range(4)]
    table = language.letter_symbols({"x": sample})
    flat, _ = language.parse_table(sample, table)
    symbols = lambda t: "".join(chr(65 + s) for s in language.symbols([t], table)[0])
    joined = "|".join(symbols(t) for t in sample)
    for _ in range(40):
        text = "".join(pick.choice("abcd ") for _ in range(pick.randrange(1, 200)))
        found, offsets, _ = language.symbols([text], table)
        assert language.phrase_counts(found, offsets, flat)[0] == phrases(symbols(text), joined)


def test_segments_and_many_texts_side_by_side():
    sample = ["abcabcaabb" * 20]
    table = language.letter_symbols({"x": sample})
    flat, _ = language.parse_table(sample, table)
    several = ["abc" * 300, "", "cab", "b" * 1000, "aabb" * 64]
    found, offsets, _ = language.symbols(several, table)
    together = language.phrase_counts(found, offsets, flat)
    for i, text in enumerate(several):
        own = language.symbols([text], table)
        assert language.phrase_counts(own[0], own[1], flat)[0] == together[i]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    found = language.identify(docs, language.language_model(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.where(language.held_out("doc_id")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_learning_uses_no_held_out_row(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    changed = docs.withColumn("lang", F.when(language.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang")))
    model = language.language_model(changed)
    assert "zz" not in model["names"] and model["names"]


def test_hard_rows_of_language(spark):
    docs = hard_docs(spark)
    model = language.language_model(spark.read.parquet(f"{SMALL}/documents.parquet"))
    found = language.identify(docs, model).collect()
    assert len(found) == len(HARD)
    labels = [(r.doc_id, r.lang_pred, r.score) for r in found]
    assert all(x == "und" and s == 0 for i, x, s in labels if i in (1, 2, 3, 6, 15))
    assert all(0 <= s <= 1 and (x in model["names"] or x == "und") for _, x, s in labels)
    kept = language.accepted(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 3, 6, 15} & {r.doc_id for r in kept.collect()}
    nothing = language.language_model(docs.where("false"))
    assert nothing["names"] == [] and {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


def scripts(pick, first, letters, n):
    return ["".join(chr(first + k) for k in pick.integers(0, letters, 200)) for _ in range(n)]


def test_scripts_of_many_letters_are_told_apart(spark):
    pick = np.random.default_rng(2)
    words = {name: ["".join(chr(0x4E00 + k) for k in pick.integers(0, 3000, 3)) for _ in range(400)] for name in ("ja", "zh")}
    text = lambda name: " ".join(pick.choice(words[name], 60))
    rows = [(i, text(name), name) for i, name in enumerate(["ja", "zh"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.language_model(docs)
    found = language.identify(docs, model).join(docs, "doc_id").where(language.held_out("doc_id"))
    assert found.count() > 50 and found.where("lang != lang_pred").count() == 0
    hangul = [(1000 + i, t, "ko") for i, t in enumerate(scripts(pick, 0xAC00, 2000, 5))]
    kept = language.accepted(docs.unionByName(spark.createDataFrame(hangul, docs.schema)), model)
    assert kept.where("lang = 'ko'").count() == 0 and kept.count() == len(rows)


def test_every_label_is_learned_and_short_texts_are_judged(spark):
    pick = np.random.default_rng(3)
    own = [["".join(chr(97 + k) for k in pick.integers(0, 26, 5)) for _ in range(20)] for _ in range(70)]
    rows = [(i, " ".join(pick.choice(own[i % 70], 30)), f"l{i % 70}") for i in range(70 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.language_model(docs)
    assert len(model["names"]) == 70
    found = language.identify(docs, model).join(docs, "doc_id")
    assert found.where("lang != lang_pred").count() == 0
    short = spark.createDataFrame([(1, "абвгд" * 19 + "абвг", "x"), (2, "абвгд" * 20, "x"), (3, "abc", "x")], docs.schema)
    assert [r.doc_id for r in language.accepted(short, model).collect()] == [3]


def test_several_languages_stay_and_other_scripts_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.language_model(docs)
    mixed = " ".join(r.text[:400] for r in docs.dropDuplicates(["lang"]).collect())
    rows = plain_docs(spark, [(1, mixed), (2, "Это текст на другом языке и другим письмом. " * 10)])
    assert [r.doc_id for r in language.accepted(rows, model).collect()] == [1]


def test_no_sample_document_is_rejected(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert language.accepted(docs, language.language_model(docs)).count() == docs.count()


def test_base_statistics_equal_brute_force(spark):
    rows = [*HARD, *texts(spark, SMALL)]
    lines = ["a b\na b\n\n\nc", "x\r\nx\r\n", "a a a a a a", "| # $ %", "one two three one two three", "\n\n"]
    rows += [(20 + i, t) for i, t in enumerate(lines)]
    base = quality_rules.base_statistics(pa.array([t for _, t in rows]))
    for i, (_, text) in enumerate(rows):
        assert tuple(int(x[i]) for x in base.values()) == base_quality(text)[:-1], rows[i][0]


def test_quality_accuracy_on_unseen_labels(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{x}.parquet") for x in ("documents", "labels"))
    seen = F.col("doc_id") % 2 == 0
    model = quality_rules.fit(docs, labels.where(seen))
    found = quality_rules.judged(docs, model).join(labels.where(~seen), "doc_id")
    assert found.agg(F.avg(((F.col("p_good") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0] >= 0.97
    clean = found.where("quality = 1 AND NOT base_failed")
    assert clean.where("NOT kept").count() <= 0.01 * clean.count()
    # Calibrated: mean probability and share of good rows agree.
    mean, share = found.agg(F.avg("p_good"), F.avg("quality")).first()
    assert abs(mean - share) < 0.05


def test_hard_rows_of_quality(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(7, 1), (7, 0), (4, 0), (None, 1), (8, None), (11, 3), (99, 1)], "doc_id long, quality int")
    found = quality_rules.judged(docs, quality_rules.fit(docs, labels)).collect()
    assert len(found) == len(HARD) and all(0 <= r.p_good <= 1 for r in found)
    for r in found:
        if r.doc_id not in (None, 7, 9):
            text = dict(HARD)[r.doc_id]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_quality(text)
    none = quality_rules.fit(docs, labels.where("false"))
    assert {r.p_good for r in quality_rules.judged(docs, none).collect()} == {0.5}
    assert quality_rules.judged(docs.where("false"), none).count() == 0


def test_platt_recovers_probabilities():
    pick = np.random.default_rng(0)
    score = pick.normal(0, 2, 5000)
    label = (pick.random(5000) < 1 / (1 + np.exp(-(1.5 * score - 0.5)))).astype(float)
    slope, shift = quality_rules.platt(score, label)
    assert abs(slope - 1.5) < 0.15 and abs(shift + 0.5) < 0.15


def site_rows():
    """A large good site, a large bad one, and a small one; texts without a signal of their own in the third."""
    good = [(i, "plain words in a row " * 10, "good", 1) for i in range(200)]
    bad = [(1000 + i, "$$$ ### |||| *** %%%% !!! 99" * 10, "bad", 0) for i in range(200)]
    return good + bad + [(2000, "plain words in a row " * 10, "tiny", None)]


def test_sparse_sites_shrink_towards_the_corpus(spark):
    rows = site_rows()
    docs = spark.createDataFrame([(i, t, h) for i, t, h, _ in rows], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows if q is not None], "doc_id long, quality int")
    found = quality_sites.quality_posteriors(docs, labels, F.col("host"), F.col("host"))
    rate = {r.host: r.host_quality for r in found.select("host", "host_quality").distinct().collect()}
    assert rate["bad"] < 0.1 < 0.5 < rate["tiny"] < rate["good"] and rate["good"] > 0.9
    kept = {r.doc_id for r in found.where("kept").collect()}
    assert kept == {i for i, _, h, _ in rows if h != "bad"}


def test_accuracy_of_site_quality(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{x}.parquet") for x in ("documents", "labels"))
    seen = F.col("doc_id") % 2 == 0
    found = quality_sites.quality_posteriors(docs, labels.where(seen), F.col("source"), F.concat_ws("/", "source", "lang"))
    unseen = found.join(labels.where(~seen).withColumnRenamed("quality", "label"), "doc_id")
    assert unseen.agg(F.avg((F.col("kept") == (F.col("label") == 1)).cast("double"))).first()[0] >= 0.95
    good = unseen.where("label = 1")
    assert good.where("NOT kept").count() <= 0.01 * good.count()


def test_hard_rows_of_site_quality(spark):
    docs = hard_docs(spark).withColumn("source", F.when(F.col("doc_id") > 5, F.col("source")))
    labels = spark.createDataFrame([(7, 1), (15, 0), (None, 1), (8, None)], "doc_id long, quality int")
    for own in (labels, labels.where("false")):
        found = quality_sites.quality_posteriors(docs, own, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
        assert len(found) == len(HARD)
        assert all(0 <= r.quality <= 1 and 0 <= r.host_quality <= 1 for r in found)
    assert quality_sites.quality_posteriors(docs.where("false"), labels, F.col("source"), F.col("lang")).count() == 0


def test_sites_of_urls(spark):
    urls = ["http://www.Example.com/en/825?page=2", "https://m.a.net:80/x#top", "https://u:p@b.org", "nonsense", None]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    found = rows.select(quality_sites.url_host(F.col("url")).alias("h"), quality_sites.url_path(F.col("url")).alias("p")).collect()
    assert [(r.h, r.p) for r in found] == [("example.com", "example.com/en"), ("m.a.net", "m.a.net/x"), ("b.org", "b.org/"), (None, None), (None, None)]


def test_plain_rows_keep_their_order_of_ids(spark):
    found = quality_rules.judged(plain_docs(spark, [(5, "a b"), (4, "c")]), quality_rules.train(pa.table({"id": pa.array([], pa.int64()), "label": pa.array([], pa.int32()), "feature": pa.array([], pa.list_(pa.int32())), "value": pa.array([], pa.list_(pa.float32()))})))
    assert sorted((r.doc_id, r.n_words) for r in found.collect()) == [(4, 1), (5, 2)]


def test_a_repeated_id_gives_one_row_to_each_fit(spark):
    """One labelled id in thousands of rows: the driver and the fit get one of them."""
    pick = random.Random(2)
    rows = [(1, f"same id other text {i} " + "word " * (i % 7)) for i in range(3000)] + [(i, " ".join(pick.choice("abcdef") for _ in range(60))) for i in range(2, 40)]
    docs = plain_docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    sample = quality_rules.labelled_sample(docs, labels, "doc_id", "text", "quality", 3000).collect()
    assert sorted(r.id for r in sample) == list(range(1, 40))
    assert quality_rules.fit(docs, labels)["weights"].any()
    found = quality_sites.quality_posteriors(docs, labels, F.col("source"), F.col("source"))
    assert found.count() == len(rows)


def test_a_label_of_one_repeated_id_is_learned(spark):
    """The draw goes by id; a label whose rows share one is learned all the same, from a bounded number of them."""
    rows = [(7, f"zyx wvu tsr {i}", "zz", "s") for i in range(4000)] + [(8 + i, f"hello the world {i}", "en", "s") for i in range(300)]
    labelled = spark.createDataFrame(rows, "id long, text string, lang string, source string")
    found = language.sample_texts(labelled, 96, 256)
    assert set(found) == {"zz", "en"} and all(1 <= len(own) <= 96 for own in found.values())
