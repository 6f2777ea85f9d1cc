"""Odd rows for each operator: null ids and texts, repeated rows, clashing columns, empty tables, texts over a slice's size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import doc
from tests.llm.test_operators import ODD, SCHEMA, brute_quality, shingles
from veilstone.llm import arrays, chat, decontamination, language_id, line_dedup, ngram_join, packing, quality, queries, secrets, token_counts, toxicity

CLASHES = ("key", "node", "n", "th", "rid", "part", "local", "ids", "_l", "_h", "_row", "runs", "lang_pred", "score", "at", "from", "to", "item_id", "host", "_host", "keys", "held", "component", "_low", "gram", "_found", "toxic", "doc")
TEXTS = [*ODD, "one two three four five six seven"]


@pytest.fixture(scope="module")
def odd(spark):
    """ODD texts, two rows equal in all, two of one id with different texts, and null ids; columns of all clashing names."""
    rows = [doc(k, t) for k, t in enumerate(TEXTS)] + [doc(50, "again and again")] * 2 + [doc(51, "first"), doc(51, "second")] + [doc(None, "no id"), doc(None, None), doc(None, "no id")]
    table = spark.createDataFrame([(*r[:3], None, *r[4:]) for r in rows], SCHEMA)
    return rows, table.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted((r[0] is None, r[0] or 0) for r in rows)


def test_join_of_odd_rows(odd, empty):
    rows, table = odd
    got = ngram_join.join(table, 3, 90).collect()
    assert ids(got) == ids(rows)
    one = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None and r.doc_id != 51}
    assert all(one[k][0] == len(shingles(t, 3)) for k, t in enumerate(TEXTS)) and one[50] == (1, 50)
    assert ngram_join.representatives(empty).count() == 0


def test_packing_of_odd_rows(odd, empty):
    rows, table = odd
    path = queries.tokenizer("word_bpe_49k.json")
    library, got = Tokenizer.from_file(path), packing.pack(table, path, 16).collect()
    stream = b"".join(r.ids for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)))
    sizes = [len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows]
    assert len(stream) == 2 * sum(sizes) and sorted((r.doc_id or -1, r.doc_tokens) for r in got if r.start == 0) == sorted((r[0] or -1, n) for r, n in zip(rows, sizes, strict=True))
    assert packing.pack(empty, path).count() == 0


def test_line_dedup_of_odd_rows(odd, empty):
    rows, table = odd
    got = line_dedup.dedup(table).select("_row.*", "n_removed")
    assert got.columns == [*table.columns, "n_removed"]
    assert sorted((r.doc_id or -1, r.text or "") for r in got.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert line_dedup.dedup(empty).count() == 0


def test_quality_of_odd_rows(odd, empty):
    rows, table = odd
    got = quality.judge(table).collect()
    assert sorted((r.doc_id or -1, *(r[f] for f in quality.FEATURES)) for r in got) == sorted((r[0] or -1, *brute_quality(r[1])) for r in rows)
    assert all(r.host is None for r in got) and quality.judge(empty).count() == 0


def test_decontamination_of_odd_rows(spark, odd, empty):
    rng = random.Random(21)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25))
    _, table = odd
    held = [doc(None, "x y " + item), doc(None, "x y " + item), doc(60, item), doc(60, item), doc(61, item[: len(item) // 3])]
    docs = spark.createDataFrame([(*r[:3], None, *r[4:]) for r in held], SCHEMA).withColumns({c: F.lit("x") for c in CLASHES}).unionByName(table)
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, " "), (None, item)], "item_id long, text string")
    got = decontamination.contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id or -1, r.n_items) for r in got) == [(-1, 2), (60, 2)]
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns and ids(left.collect()) == ids([r for r in table.collect() if r.doc_id is not None] + [held[4]])
    none = benchmark.limit(0)
    assert decontamination.contaminated(docs, none).count() == 0 and decontamination.contaminated(empty, benchmark).count() == 0 and decontamination.clean(docs, none).count() == docs.count()


def test_scores_of_odd_rows(spark, odd, empty):
    rows, table = odd
    train = [(k, ("you stupid fool " if k % 2 else "a fine day in town ") * (1 + k % 7)) for k in range(80)]
    docs = spark.createDataFrame([*train, train[1], (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(1, 1), (None, 1), (2, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(table, model).collect()
    assert ids(got) == ids(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert toxicity.score(empty, model).count() == 0
    by = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(by[k] == k % 2 for k in range(80)) == 80


def test_languages_of_odd_rows(spark, odd, empty):
    rows, table = odd
    train = [doc(k, "the cat and the dog " * 3 if k % 2 else "der hund und die katze " * 3, "en" if k % 2 else "de") for k in range(40)] + [doc(None, "the", "en"), doc(5, None, "en"), doc(6, "x", None)]
    model = language_id.train(spark.createDataFrame(train, SCHEMA))
    got = language_id.predict(table, model).collect()
    assert model.langs == ["de", "en"] and ids(got) == ids(rows) and language_id.predict(empty, model).count() == 0
    assert language_id.train(spark.createDataFrame(train, SCHEMA), per_language=3, most_languages=1).langs == ["en"]
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id < len(ODD) and not any(c.isalpha() for c in ODD[r.doc_id] or "")} == {"und"}


def test_counts_and_secrets_of_odd_rows(odd, empty):
    rows, table = odd
    path = queries.tokenizer("piece_bpe_32k.model")
    got = token_counts.count_tokens(table, path).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode())) for r in rows)
    assert token_counts.count_tokens(empty, path).count() == 0
    found = secrets.scan(table).collect()
    assert ids(found) == ids(rows) and secrets.scan(empty).count() == 0


def test_conversations_of_odd_rows(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (None, 1, "assistant", None), (2, 0, "user", "d"), (2, 0, "user", "d"), (3, None, None, None)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("formatted", "segments", "valid", "_t", "nth")})
    got = {r.conv_id: (r.n, r.valid) for r in chat.formatted(table).select("conv_id", "valid", F.size(chat.read_back(F.col("formatted"))).alias("n")).collect()}
    assert got == {1: (2, True), None: (2, True), 2: (2, False), 3: (1, False)}
    assert chat.formatted(table.limit(0)).count() == 0


def test_slices_cover_all_rows():
    offsets = np.array([0, 3, 3, 20, 21, 40, 41])
    for limit in (1, 4, 20, 100):
        parts = list(arrays.slices(offsets, limit))
        assert [a for a, _ in parts] == [0, *(b for _, b in parts[:-1])] and parts[-1][1] == 6
        assert all(offsets[b] - offsets[a] <= limit or b == a + 1 for a, b in parts)


def test_texts_over_a_slice(spark):
    """A text that is longer than a slice, its near copy, and short ones around them in one batch."""
    import sentencepiece

    rng = random.Random(22)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    lines = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(62_000)]
    long = "\n".join(lines)
    assert len(long) > arrays.SLICE_BYTES
    near = long + "\nand password = hunter22 at the very end"
    texts = ["short one here", long, "the cat", near, "tail end"]
    table = spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(table, 3, 90).collect()}
    assert joined == {0: (1, 0), 1: (len(shingles(long, 3)), 1), 2: (1, 2), 3: (len(shingles(near, 3)), 1), 4: (1, 4)}
    cut = {r.doc_id: r.text for r in line_dedup.dedup(table).select("_row.*").collect()}
    assert [cut[k] for k in (0, 1, 2, 4)] == [texts[k] for k in (0, 1, 2, 4)] and cut[3] == "and password = hunter22 at the very end"
    path = queries.tokenizer("word_bpe_49k.json")
    library, got = Tokenizer.from_file(path), {}
    for r in sorted(packing.pack(table, path).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).append(r.ids)
    assert all(b"".join(got[k]) == np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u2").tobytes() for k, t in enumerate(texts))
    path = queries.tokenizer("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, path).collect()} == {k: len(model.encode(t)) for k, t in enumerate(texts)}
    measured = {r.doc_id: tuple(r[f] for f in quality.FEATURES) for r in quality.judge(table).collect()}
    assert all(measured[k] == brute_quality(t) for k, t in enumerate(texts))
    spans = {r.doc_id: [(s.kind, s.start) for s in r.found] for r in secrets.scan(table).collect()}
    assert spans[3] == [("assign", near.index("password"))] and spans[1] == []


@pytest.fixture(scope="module")
def over_a_slice():
    rng = random.Random(23)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(420_000))
    assert len(long) > arrays.SLICE_BYTES
    return rng, words, long


def test_long_texts_are_decontaminated(spark, over_a_slice):
    rng, words, long = over_a_slice
    items = [" ".join(rng.choice(words) + "q" for _ in range(n)) for n in (3, 20, 40)]
    cut = len(long) // 2
    texts = ["short " + items[1], long[:cut] + " " + items[0] + " " + long[cut:] + " " + items[2], long, "end"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(table, benchmark).collect()} == {(0, 1), (1, 0), (1, 2)}


def test_equal_matches_give_the_least_item(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    benchmark = spark.createDataFrame([(7, text), (3, text.upper()), (9, text), (5, "other words that nobody has")], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame([doc(1, "x " + text + " y"), doc(2, "none of it")], SCHEMA), benchmark).collect()
    assert [(r.doc_id, r.n_items, r.item_id, r.lcs) for r in got] == [(1, 3, 3, 1.0)]


def test_long_texts_are_scored(spark, over_a_slice):
    rng, _, long = over_a_slice
    train = [(k, ("you stupid fool " if k % 2 else "a fine day in town ") * (1 + k % 7)) for k in range(80)]
    docs = spark.createDataFrame(train, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int"))
    texts = ["you stupid fool", "you stupid fool " * 140_000, "a fine day in town " * 120_000]
    assert min(map(len, texts[1:])) > arrays.SLICE_BYTES
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()}
    assert got == {0: 1, 1: 1, 2: 0}
    rows = [doc(k, "the cat and the dog " * 3 if k % 2 else "der hund und die katze " * 3, "en" if k % 2 else "de") for k in range(40)]
    languages = language_id.train(spark.createDataFrame(rows, SCHEMA))
    texts = ["the dog", "der hund und die katze " * 100_000, "the cat and the dog " * 110_000, "1" * 3_000_000]
    told = {r.doc_id: r.lang_pred for r in language_id.predict(spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], SCHEMA).coalesce(1), languages).collect()}
    assert told == {0: "en", 1: "de", 2: "en", 3: "und"}


def stages(spark, docs, sf_dir):
    import corpus_pipeline
    from veilstone.llm import store

    seen = []
    for nth, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if nth < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = store.keep(out, "edge-output")
            seen.append(docs.collect())
        else:
            seen.append(out.collect())
    store.release(spark, "edge-output")
    return seen


def test_pipeline_of_odd_rows(spark, tables):
    rng = random.Random(24)
    words = [f"word{k}" for k in range(300)]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, near = draw(30), draw(80)
    rows = [doc(k, draw(60) + " the cat and the dog", "en") for k in range(30)] + [doc(100, near), doc(101, near + " more"), doc(102, draw(20) + " " + item + " " + draw(20))]
    rows += [doc(None, draw(50)), doc(None, None), doc(103, ""), doc(103, "12 34"), doc(5, rows[5][1]), doc(104, "a\n" * 3 + draw(40))]
    at = tables(documents=rows, benchmark=[(1, item), (2, None)])
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "lang_pred", "n_removed", "runs", "key", "node", "item_id", "part", "_row")})
    language, lines, near_ones, clean, packed = stages(spark, docs, at)
    assert {r.doc_id for r in language} >= {*range(30), 100, 101, 102, 104, None} and not any(r.doc_id == 103 for r in language)
    assert sum(r.doc_id == 5 for r in language) == 2 and sum(r.doc_id == 5 for r in near_ones) == 1 and 102 in {r.doc_id for r in near_ones}
    assert {r.doc_id for r in lines} <= {r.doc_id for r in language} and len({r.doc_id for r in near_ones} & {100, 101}) == 1
    assert {r.doc_id for r in clean} == {r.doc_id for r in near_ones} - {102} and {r.doc_id for r in packed} == {r.doc_id for r in clean}
    empty = stages(spark, docs.limit(0), at)
    assert all(not rows for rows in empty)
