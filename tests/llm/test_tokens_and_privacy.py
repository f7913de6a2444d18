"""Packing, token files, personal data, chat rotation."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import HARD, crc, hard_docs, personal, plain_docs, redact, texts, tokenizer
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import chat_rotation, packing, personal_data, token_files, tokens
from gaugeworks.llm.common import new_folder


@pytest.fixture(scope="module")
def encode():
    own = tokenizer()
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_word_by_word_equals_whole_texts(spark, encode):
    rows = [t for _, t in HARD] + [t for _, t in texts(spark, SMALL)]
    rows += ["it's don't <|endoftext|> x<|startoftext|>y", "é ́a", "ΑΣ ΑΣΑ İ", "1234 a1b2 ...!?"]
    own = tokens.Encoder(tokens.default_tokenizer())
    for text, data in zip(rows, own.encode(rows), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == encode(text)


def test_kept_words_are_bounded(monkeypatch, encode):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    monkeypatch.setattr(tokens, "CHUNK", 100)
    own = tokens.Encoder(tokens.default_tokenizer())
    rows = [" ".join(f"w{(i * 7 + j) % 300}" for j in range(20)) for i in range(100)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(rows)] == [encode(t) for t in rows]
    assert len(own.known) <= 50 and len(own.before) <= 50


def test_long_words_are_not_kept(encode):
    """Encoded blobs may be all distinct and of any length: they are encoded, not remembered."""
    own = tokens.Encoder(tokens.default_tokenizer())
    rows = [" ".join((chr(97 + i % 26) + chr(97 + i // 26) + chr(105 + j)) * 400 for j in range(8)) + " the end" for i in range(40)]
    for text, data in zip(rows, own.encode(rows), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == encode(text)
    assert max(map(len, own.known)) <= tokens.KEPT_LENGTH and len(own.known) < 10


def test_odd_words_are_encoded_like_whole_texts(encode):
    pick = random.Random(8)
    letters = "abcXYZ.,;:!?'\"<>|-0123é漢́ \n\xa0\x1c"
    rows = ["".join(pick.choice(letters) for _ in range(pick.randrange(80))) for _ in range(400)]
    rows += ["<|ENDOFTEXT|> <|endoftext|>. A. 1. .. x?! don't. THE, İ. ſ, K! \u0958. É, Straße."]
    own = tokens.Encoder(tokens.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(rows)] == [encode(t) for t in rows]


def check_packing(found, rows, encode, capacity):
    ids = Counter((i, crc(encode(t) + [0])) for i, t in rows)
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(encode(t) + [0])
    for i, own in by_id.items():
        want = Counter((k, k * capacity, len(x[k * capacity : (k + 1) * capacity]), crc(x[k * capacity : (k + 1) * capacity])) for x in own for k in range(-(-len(x) // capacity)))
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == want
    assert ids
    return len(sequences)


def test_packing_of_documents(spark, encode):
    rows = texts(spark, SMALL)
    found = packing.pack(plain_docs(spark, rows)).collect()
    used = check_packing(found, rows, encode, 2048)
    total = sum(len(encode(t)) + 1 for _, t in rows)
    assert used <= -(-total // 2048) + 1


def test_hard_rows_of_packing(spark, encode):
    check_packing(packing.pack(hard_docs(spark), capacity=64).collect(), HARD, encode, 64)
    assert packing.pack(hard_docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=31)
    patterns = packing.plan(counts, 30)
    used = Counter()
    for items, times in patterns:
        assert sum(items) <= 30 and times > 0
        for length in items:
            used[length] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in patterns) <= 2 * -(-sum(lengths) // 30)
    for length, (first, _, _) in packing.places(patterns).items():
        assert first[0] == 0 and (np.diff(first) > 0).all() and counts[length]


def test_complements_fill_exactly():
    counts = np.zeros(2049, np.int64)
    counts[[1500, 548, 1000, 700, 348, 900, 648, 500]] = 5, 5, 7, 7, 7, 4, 4, 4
    patterns = packing.plan(counts, 2048)
    assert sum(t for _, t in patterns) == 5 + 7 + 4
    assert all(sum(items) == 2048 for items, _ in patterns)


def test_token_files_round_trip(spark, encode):
    rows = [x for x in HARD if x[0] not in (7, 9, None)] + [(100 + i, t) for i, t in texts(spark, SMALL)]
    folder = new_folder(spark, "round-trip")
    token_files.write_tokens(plain_docs(spark, rows), folder)
    stored = token_files.read_tokens(spark, folder)
    assert {r.doc_id: list(r.ids) for r in stored.collect()} == {i: encode(t) + [1] for i, t in rows}
    found = {r.doc_id: r for r in token_files.digests(stored).collect()}
    at = 0
    for i, text in sorted(rows):
        ids = encode(text) + [1]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    # Files and parts are in ascending order of ids.
    ranges = stored.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("part").collect()
    assert all(a.high < b.low for a, b in zip(ranges, ranges[1:], strict=False))
    plan = stored.where("doc_id = 104")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,104)]" in plan


def test_hard_rows_of_token_files(spark, encode):
    folder = new_folder(spark, "hard")
    token_files.write_tokens(hard_docs(spark), folder)
    found = token_files.digests(token_files.read_tokens(spark, folder)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(encode(t)) + 1, crc(encode(t) + [1])) for i, t in HARD)
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    empty = new_folder(spark, "empty")
    token_files.write_tokens(hard_docs(spark, []), empty)
    assert token_files.digests(token_files.read_tokens(spark, empty)).count() == 0


ODD = [
    "a@b.c%w@q.rr x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "41111111111111114111111111111111", "+1 (988) 555-2485. +12 345 +1-2", "x+1234567890@d.ee", "+1 2 3 4 5 6 7 8 .",
    "4111 1111 1111 1111 +44 20 7946 0958 me@x-y.org 10.0.0.1", "é漢@x.yz \U0001f600 10.20.30.40 \U0001f600 z@z.zz",
]


def test_base_spans_equal_brute_force(spark):
    pick = random.Random(4)
    noise = ["".join(pick.choice("0123456789.@+- ()ab%") for _ in range(pick.randrange(200))) for _ in range(300)]
    rows = list(enumerate(ODD + noise)) + [(1000 + i, t) for i, t in texts(spark, SMALL)]
    found = {r.doc_id: r for r in personal_data.span_digest(personal_data.personal_spans(plain_docs(spark, rows))).collect()}
    for i, text in rows:
        form = ",".join(f"{k}:{a}:{b}" for k, a, b in personal(text))
        assert found[i].base_sha256 == hashlib.sha256(form.encode()).hexdigest(), text
        assert found[i].spans.startswith(form)
        counts = Counter(k for k, _, _ in personal(text))
        assert [found[i][f"n_{k}"] for k in personal_data.KINDS] == [counts[k] for k in personal_data.KINDS]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.{i % 200}" for i in range(700))
    row = personal_data.span_digest(personal_data.personal_spans(plain_docs(spark, [(1, text)]))).first()
    assert row.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in personal(text))


def test_running_values_and_parts_of_long_arrays(spark):
    """By blocks of blocks: every border between them, sums and maxima, and places of a text given as chunks."""
    pick = random.Random(6)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 9001):
        values = [pick.randrange(1000) for _ in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        sums, tops = df.select(personal_data.running_sum(F.col("v")), personal_data.running_max(F.col("v"))).first()
        assert sums == np.cumsum(values).tolist() if n else sums == []
        assert tops == (np.maximum.accumulate(values).tolist() if n else [])
    text = "".join(pick.choice("ab \n漢é😀") for _ in range(1500))
    places = [(a, b) for a in (0, 1, 255, 256, 257, 511, 1499, 1500) for b in (0, 1, 64, 255, 256, 257, 900)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a int, b int")
    found = df.select("a", "b", personal_data.part(personal_data.chunks(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(r.p == text[r.a : r.a + r.b] for r in found)


def test_time_grows_with_the_text_not_its_square(spark):
    """Sixteen times the addresses and ids in one text."""
    import time

    def taken(n):
        text = " ".join(f"u{i}@h{i}.org id-{i}x 10.0.{i % 256}.{i % 200} user {i}" for i in range(n))
        docs = plain_docs(spark, [(1, text)])
        started = time.time()
        personal_data.found_in(personal_data.keyed(docs, "doc_id", "text")).write.format("noop").mode("overwrite").save()
        return time.time() - started

    taken(100)
    small, large = taken(300), taken(4800)
    assert large < 20 * small + 5


def test_overlapping_spans_become_one(spark):
    """Spans that touch stay apart; those that overlap, also by way of others, are cut as one of the first one's kind."""
    rows = [[(0, 4, "A"), (2, 9, "B"), (5, 6, "C"), (8, 12, "D"), (12, 13, "E"), (20, 22, "F")], [(1, 2, "A")], [(0, 100, "A"), (3, 4, "B"), (99, 101, "C"), (101, 102, "D")]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, cuts array<struct<start:int,end:int,kind:string>>")
    found = {r.id: [tuple(x) for x in r.j] for r in df.select("id", personal_data.joined_spans(F.col("cuts")).alias("j")).collect()}
    assert found == {0: [(0, 12, "A"), (12, 13, "E"), (20, 22, "F")], 1: [(1, 2, "A")], 2: [(0, 101, "A"), (101, 102, "D")]}


def test_hard_rows_of_personal_data(spark):
    docs = hard_docs(spark)
    found = personal_data.personal_spans(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in HARD)
    changed = personal_data.redacted(docs)
    assert changed.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in changed.collect()), key=key) == sorted(((i, t if t is None else redact(t)) for i, t in HARD), key=key)
    assert personal_data.personal_spans(hard_docs(spark, [])).count() == 0


CONTEXTS = [(i, f"some text here member-id: user{i}@mail.org was seen in the log") for i in range(6)]


def test_contexts_of_seeds_find_other_identifiers(spark):
    rows = CONTEXTS + [
        (10, "again the member-id: QX7731 was a guest"), (11, "QX7731 came back"), (12, "in 1984 the log was seen"),
        (13, "the 77th row of the text here"), (14, "see member-id: QX7731 was"),
    ]
    found = {r.doc_id: [text_of(rows, r.doc_id)[s.start : s.end] for s in r.others] for r in personal_data.personal_spans(plain_docs(spark, rows)).collect()}
    assert found[10] == found[11] == found[14] == ["QX7731"]
    assert found[12] == found[13] == [] and all(not found[i] for i, _ in CONTEXTS)
    changed = {r.doc_id: r.text for r in personal_data.redacted(plain_docs(spark, rows)).collect()}
    assert changed[11] == "[OTHER] came back" and changed[0].count("[EMAIL]") == 1 and changed[12] == rows[8][1]


def text_of(rows, doc):
    return next(t for i, t in rows if i == doc)


def test_few_seeds_induce_nothing(spark):
    rows = CONTEXTS[:2] + [(10, "again the member-id: QX7731 was a guest")]
    assert all(not r.others for r in personal_data.personal_spans(plain_docs(spark, rows)).collect())


def test_personal_data_uses_no_python(spark):
    plan = personal_data.redacted(plain_docs(spark, CONTEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def rotate(rows):
    """All renderings, in plain Python."""
    out = defaultdict(list)
    people = defaultdict(set)
    for conv, _, who, _ in rows:
        if (who or "unknown") != "system":
            people[conv].add(who or "unknown")
    for conv, names in people.items():
        own = [(t, w or "unknown", (x or "").replace("<|", "< |")) for c, t, w, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for name in names:
            at = 0
            for n, (turn, who, text) in enumerate(own):
                head = "<|system|>\n" if who == "system" else "<|assistant|>\n" if who == name else f"<|user name={who}|>\n"
                whole = f"{head}{text}\n"
                loss = at + len(head) if who == name else at + len(whole)
                out[conv, name].append((n, turn, who, whole, at, at + len(whole), loss, at + len(whole)))
                at += len(whole)
    return out


def test_rotations_equal_plain_python(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "cy", "<|assistant|> é"), (1, 4, "ann", "\U0001f600"),
            (2, None, None, "lost"), (2, 0, "ann", ""), (3, 0, "system", "alone"), (None, 0, "ann", "x"), (None, 1, "bob", "y")]
    rows += [(9, t, f"s{t % 3}", f"turn {t}") for t in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, size int")
    found = defaultdict(list)
    for r in chat_rotation.rotations(docs).collect():
        found[r.conv_id, r.perspective].append((r.position, r.turn, r.speaker, r.rendered, r.start, r.end, r.loss_start, r.loss_end))
    assert {k: sorted(v) for k, v in found.items()} == dict(rotate(rows))


def test_equal_turns_are_kept_and_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([(1, 0, "ann", "x")] * 3 + [(1, 0, "bob", "y")], "conv_id long, turn long, role string, text string")
    found = chat_rotation.rotations(docs)
    assert found.count() == 8 and sorted(r.position for r in found.where("perspective = 'bob'").collect()) == [0, 1, 2, 3]
    assert chat_rotation.rotations(docs.where("false")).count() == 0


def test_encoder_keeps_a_bounded_number_of_words_and_asks_for_its_model_once():
    """A worker kept up to 1.2 million words, some 250 MB; each new one made a new object of the model."""
    from gaugeworks.llm.tokens import Encoder, default_tokenizer

    own = Encoder(default_tokenizer())
    letters = "abcdefghijklmnopqrst"
    words = [f"{letters[i % 20]}{letters[i // 20 % 20]}{letters[i // 400 % 20]}{letters[i // 8000 % 20]}{letters[i // 160000]}" for i in range(600_000)]
    first = b"".join(own.encode([" ".join(words[:1000])]))
    for at in range(0, len(words), 50_000):
        list(own.encode([" ".join(words[at : at + 50_000])]))
    assert len(own.known) + len(own.before) <= 400_000
    assert b"".join(own.encode([" ".join(words[:1000])])) == first
    assert own.tokenize is not None and own.of_model("the") == own.tokenizer.encode("the", add_special_tokens=False).ids


def test_packing_sends_texts_in_small_batches(spark, monkeypatch):
    """By rows alone a batch had 10,000 texts: a JVM and its workers held hundreds of megabytes of them."""
    from gaugeworks.llm import common
    from gaugeworks.tuning import BATCH_BYTES, BATCH_SETTING

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    sizes = []

    def sent(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["n"])

    def seen(df, *rest):
        sizes.append([r.n for r in docs.mapInArrow(sent, "n long").collect()])
        return common.written(df, *rest)

    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, "64m")
    monkeypatch.setattr(packing, "written", seen)
    found = packing.pack(docs)
    assert sum(sizes[0]) > 2 * BATCH_BYTES and max(sizes[0]) < 2 * BATCH_BYTES
    assert len(sizes) == 2 and len(sizes[1]) == 1 and spark.conf.get(BATCH_SETTING) == "64m"
    spark.conf.set(BATCH_SETTING, before)
    assert found.select("doc_id").distinct().count() == 3000


def test_language_stage_asks_for_small_batches(spark):
    import corpus_pipeline
    from gaugeworks.tuning import BATCH_BYTES, BATCH_SETTING

    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, "64m")
        corpus_pipeline.known_language(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
        assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_new_words_go_to_the_tokenizer_many_at_once():
    """Each new word was a call of its own, which made objects for its tokens: a third of op6's time."""
    from gaugeworks.llm.tokens import Encoder, default_tokenizer

    own = Encoder(default_tokenizer())
    own.load()
    asked = []
    alone, own.tokenize = own.tokenize, lambda word: asked.append(word) or alone(word)
    words = [f"{a}{b}{c}" for a in ("qu", "Été", "straße", "õn") for b in "abcdefghij" for c in ("x", "ZÀ", "ñor", "÷s")]
    found = b"".join(own.encode([" ".join(words)]))
    assert not asked
    assert np.frombuffer(found, "<u4").tolist() == own.tokenizer.encode(" ".join(words), add_special_tokens=False).ids


def test_a_worker_gives_memory_back_after_a_batch():
    """Arrow kept what it had used in one stage through those that followed."""
    import pyarrow as pa

    from gaugeworks.llm import tokens

    given = []
    before, tokens.give_back = tokens.give_back, lambda: given.append(pa.total_allocated_bytes())
    try:
        list(tokens.Encoder(tokens.default_tokenizer()).encode(["some words"] * 3))
    finally:
        tokens.give_back = before
    assert len(given) == 1


def test_language_is_parsed_in_small_chunks():
    """Chunks of four million symbols took 115 MB of a worker; now texts of a batch are parsed in parts, with the same results."""
    import tracemalloc

    from gaugeworks.llm import language

    texts = {"a": ["the cat sat on the mat " * 8], "b": ["le chat est sur le tapis " * 8]}
    table = language.letter_symbols(texts)
    model = {"names": ["a", "b"], "symbols": table, "tables": [language.parse_table(texts[n], table) for n in ("a", "b")], "letters": [9, 9]}
    many = [("the mat is on the cat " if i % 2 else "le tapis est le chat ") * 100 for i in range(language.CHUNK // 2100)]
    tracemalloc.start()
    labels, scores, _ = language.predicted(many, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    one = [language.predicted([t], model) for t in many[:2]]
    assert labels[:2] == [x[0][0] for x in one] and scores[:2].tolist() == [x[1][0] for x in one]


def test_kept_words_of_the_older_generation_are_not_encoded_again(monkeypatch, encode):
    """When a new generation began, words that only the older one had went to the tokenizer once more."""
    from gaugeworks.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_WORDS", 50)
    own = tokens.Encoder(tokens.default_tokenizer())
    whole, asked = own.whole, []
    own.whole = lambda words: asked.extend(words) or whole(words)
    letters = "abcdefghij"
    words = [f"q{a}{b}" for a in letters for b in letters]
    texts = [" ".join(words[a:b]) for a, b in ((0, 40), (40, 80), (10, 70))]
    for text in texts:
        assert np.frombuffer(next(own.encode([text])), "<u4").tolist() == encode(text)
    assert sorted(asked) == sorted(words[:80])


def test_token_files_send_texts_and_ids_in_small_batches(spark, monkeypatch, tmp_path):
    """By rows alone a batch had 10,000 texts or their ids: an executor came to more than 3 GB."""
    from gaugeworks.llm import common, token_files
    from gaugeworks.tuning import BATCH_BYTES, BATCH_SETTING

    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 400).alias("text"))
    before, settings = spark.conf.get(BATCH_SETTING), []
    small = common.small_batches

    def seen(session):
        settings.append(session.conf.get(BATCH_SETTING))
        return small(session)

    try:
        spark.conf.set(BATCH_SETTING, "64m")
        monkeypatch.setattr(token_files, "small_batches", seen)
        token_files.write_tokens(docs, str(tmp_path / "ids"))
        tokens_read = token_files.read_tokens(spark, str(tmp_path / "ids"))
        monkeypatch.setattr(token_files, "written", lambda df, *rest: settings.append(int(spark.conf.get(BATCH_SETTING))) or common.written(df, *rest))
        found = token_files.digests(tokens_read)
        assert settings == ["64m", "64m", BATCH_BYTES] and spark.conf.get(BATCH_SETTING) == "64m"
    finally:
        spark.conf.set(BATCH_SETTING, before)
    assert [r.n_tokens for r in found.select("n_tokens").distinct().collect()] == [801] and found.count() == 2500
