"""The pipeline, stage by stage, next to plain Python; the registered queries."""

import re
import zlib
from collections import Counter
from pathlib import Path

import brute
import duckdb
import pandas as pd
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
import corpus_pipeline
from gaugeworks.llm import queries
from gaugeworks.llm.common import written
from test_queries import normal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_plain_python(spark, tmp_path):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    added = brute.plain_docs(spark, [(9001, None), (9002, "123 ..."), (9003, "see " + bench[1][1]), (9004, "write to me@home.org at once")])
    docs = docs.unionByName(added)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        steps.append(docs)
    assert all(s.columns == COLUMNS for s in steps[:-1])

    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    assert sorted(r.doc_id for r in steps[0].collect()) == sorted(i for i, _ in rows)
    groups, _ = brute.similar_groups(rows)
    first = {}
    for (i, _), g in zip(rows, groups, strict=True):
        first[g] = min(i, first.get(g, i))
    rows = [(i, t) for i, t in rows if i in set(first.values())]
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(i for i, _ in rows)
    bad = {d for d, _ in brute.leaks(rows, bench)}
    assert 9003 in bad
    rows = [(i, t) for i, t in rows if i not in bad]
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(i for i, _ in rows)
    rows = [(i, brute.redact(t)) for i, t in rows]
    assert {r.doc_id: (r.text, r.n_chars) for r in steps[3].collect()} == {i: (t, len(t)) for i, t in rows}
    encode = brute.tokenizer().encode
    want = Counter()
    for i, t in rows:
        ids = encode(t, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), brute.crc(ids[k : k + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in steps[4].collect()) == want


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() > 0 and "sequence_id" in found.columns
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_everything_is_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in Path(SMALL).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    mine, theirs = normal(queries.QUERIES[name](spark, SMALL).toPandas()), normal(duck.execute(queries.ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op12_spelling_variants"}))
def test_query_without_sql_covers_its_table(spark, name):
    found = queries.QUERIES[name](spark, SMALL).toPandas()
    docs = {i for i, _ in brute.texts(spark, SMALL)}
    assert set(found["doc_id"]) == docs if not name.startswith("op10") else set(found["doc_id"]) <= docs


def test_spelling_variants_cover_the_words_of_their_table(spark):
    """By its contract the query has a row for each word, none for documents."""
    count = Counter()
    for doc_id, text in brute.texts(spark, SMALL):
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(brute.LOW)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    found = [(r.word, r.n) for r in queries.QUERIES["op12_spelling_variants"](spark, SMALL).collect()]
    assert sorted(found) == sorted((w, n) for w, n in count.items() if len(w) >= 5 and n >= 3) and found
