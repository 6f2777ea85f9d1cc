"""Each operator against a brute-force version, with odd rows: nulls, empty texts, ties, repeats, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import doc
from veilstone.llm import arrays, chat, decontamination, language_id, line_dedup, ngram_join, packing, quality, queries, secrets, token_counts, toxicity
from veilstone.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "a", "A b", "é 😀  x", "x" * 5000, "\ta\x0b b \r\n c", "ſt K", "日本語 テキスト", "$$$ ### 123"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([doc(k, t) for k, t in enumerate(texts)], schema)


def shingles(text, n):
    w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(texts, n, percent):
    sets, up = [shingles(t, n) for t in texts], list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_texts(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = list(ODD) + ["a b", "A B", "a  b c"]
    for size in (12, 30, 60, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w).capitalize())
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    return out + [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 60))) for _ in range(12)] + [passage]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(spark, n, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", 2)  # so that runs are used on few rows too
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(frame(spark, texts), n, percent).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts, n, percent)


def test_ngram_join_keys_lose_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(400):
        size = int(rng.integers(9, 80))
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        y = x.copy()
        for _ in range(int(rng.integers(0, max(2, size // 9)))):
            y = np.delete(y, rng.integers(len(y))) if rng.random() < 0.5 else np.append(y, rng.integers(0, 2**63, 1, dtype=np.uint64) * np.uint64(2))
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if both == len(x) == len(y) or 100 * both < 90 * (len(x) + len(y) - both):
            continue
        level = lambda h: (h >> np.uint64(20)) % np.uint64(5)
        x, y = (v[np.lexsort((v, level(v)))] for v in (x, y))
        for keys in (ngram_join.singles, ngram_join.runs):
            assert len(np.intersect1d(keys(x, 90, 100), keys(y, 90, 100)))


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_ngram_join_runs_of_short_sets_lose_no_pair(percent):
    tokens = np.arange(1, 14, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in range(4, 14):
        union = tokens[:size]
        for x_only, y_only in itertools.product(range(4), repeat=2):
            if not x_only + y_only or 100 * (size - x_only - y_only) < percent * size:
                continue
            for lost in itertools.permutations(range(size), x_only + y_only):
                x, y = np.delete(union, lost[:x_only]), np.delete(union, lost[x_only:])
                assert len(np.intersect1d(ngram_join.runs(x, percent, 100), ngram_join.runs(y, percent, 100))), (x_only, y_only, size)


def test_ngram_join_repeats_and_nulls(spark):
    rows = [doc(5, "a b c d"), doc(5, "a b c d"), doc(2, "a b c d"), doc(None, "a b c d"), doc(None, "zz"), doc(9, None)]
    got = sorted(map(str, ngram_join.join(spark.createDataFrame(rows, SCHEMA), 3, 90).collect()))
    assert got == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={c})" for i, n, c in [(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (None, 1, None), (9, 0, 9)])
    kept = ngram_join.representatives(spark.createDataFrame(rows + [doc(2, "a b c d")], SCHEMA), 3, 90).collect()
    assert sorted((r.doc_id or 99, r.text) for r in kept) == [(2, "a b c d"), (9, None), (99, "zz")]
    assert ngram_join.join(frame(spark, []), 3, 90).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {v: v for e in links for v in e}
    for _ in range(200):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == up


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    path = queries.tokenizer("word_bpe_49k.json")
    monkeypatch.setattr(packing, "PART_BYTES", 1000)  # so that long texts are taken in parts
    texts = ODD + ["don't 'sx a<|endoftext|>b, c."] * 3 + ["the cat sat " * n for n in (10, 900, 2500)] + ["y" * 3000 + " Ünder, *** (x)  ends" * 60 + "\n"]
    rows = packing.pack(frame(spark, texts), path, 2048, 1).collect()
    tokenizer = Tokenizer.from_file(path)
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    pieces = sorted((r.sequence_id * 2048 + r.offset, r.doc_id, r.start, r.length, r.ids, r.doc_tokens) for r in rows)
    at = 0
    got = {k: [] for k in want}
    for begin, d, start, length, ids, total in pieces:
        assert begin == at and start == len(got[d]) and total == len(want[d]) and begin % 2048 + length <= 2048 and length > 0
        got[d] += np.frombuffer(ids, "<u2").tolist()
        at += length
    assert got == want
    digest = packing.pack(frame(spark, texts), path, 2048, 1, digest=True).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in digest} == {(d, s): zlib.crc32(np.frombuffer(i, "<u2").astype("<u4").tobytes()) for _, d, s, _, i, _ in pieces}
    assert packing.pack(frame(spark, []), path).count() == 0


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    rng = random.Random(5)
    texts = ODD + ["  a  b", "<s></s> \n\n x", "a" * 2000, " " * 40 + "x" + " " * 17, "▁▁a ▁", "\t\t x\x00y", "﷽" * 3] + ["".join(rng.choice("aebtion shé▁ \n1日") for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, texts), path, 1000).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {k: (len((t or "").encode()), n := len(model.encode(t or "")), n > 1000) for k, t in enumerate(texts)}
    assert got == want


def test_token_counts_of_unbroken_texts():
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    model, machine, rng = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Transducer(token_counts.sentencepiece_ranks(path)), random.Random(7)
    texts = ["a" * 6000, "", "ab" * 1500, "xyzzy" * 700, "".join(rng.choice("aeinrst") for _ in range(4000)), "a" * 255 + "b" + "a" * 900, "=-" * 600 + " " + "q" * 700, "a" * 256, "x" + "a" * 2000]
    data, offsets = arrays.utf8(pa.array(texts))
    assert machine.counts(*token_counts.code_points(data, offsets)).tolist() == [len(model.encode(t)) for t in texts]


def test_token_counts_outlive_a_full_table(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_BITS", 12)
    monkeypatch.setattr(token_counts, "DENSE", 40)
    monkeypatch.setattr(token_counts, "CLASSES", 9)
    machine = token_counts.Transducer(token_counts.sentencepiece_ranks(queries.tokenizer("piece_bpe_32k.model")))
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(20):
        text = " ".join("".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 9))) for _ in range(60))
        codes = np.array([ord(c) for c in text], np.uint32)
        assert machine.counts(codes, np.array([0, len(codes)]))[0] == len(model.encode(text))


def brute_quality(text):
    w = re.findall(WORD, text or "")
    seen, cover, before, dup = {}, set(), set(), 0
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(k for i in at for k in range(i, i + 8))
    for line in (text or "").split("\n"):
        if re.search(WORD, line):
            dup += line in before
            before.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_quality_equals_brute_force(spark):
    rng = random.Random(7)
    texts = ODD + ["\n".join(rng.choice(["a b c d e f g h", "x #", "", " ", "i j <k> l"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    got = quality.judge(frame(spark, texts)).collect()
    for r in got:
        want = brute_quality(texts[r.doc_id])
        assert tuple(r[f] for f in quality.FEATURES) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.base_failed or not r.kept)


def test_bad_hosts_lose_their_documents(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [doc(k, good if k % 10 == 0 else "short", source="bad") for k in range(60)] + [doc(100 + k, good, source="good") for k in range(60)] + [doc(300, good, source=None), doc(301, "x", source="tiny"), doc(302, good, source="tiny")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[k] for k in range(60)) and all(got[100 + k] for k in range(60)) and got[300] and got[302] and not got[301]


def test_shrinkage_alone_judges_hosts(spark):
    """Hosts of one raw rate: the small one is kept by the prior, the large one goes; a bad host needs no size of its own."""
    good = " ".join(f"w{k}" for k in range(30))
    sizes = {"large": (90, 60), "small": (3, 2), "nineteen": (19, 18), **{f"clean{k}": (30, 1) for k in range(40)}}
    rows = [doc(1000 * h + k, "short" if k < bad else good, source=host) for h, (host, (n, bad)) in enumerate(sizes.items()) for k in range(n)]
    kept = {}
    for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect():
        kept.setdefault(r.host, []).append(r.kept)
    assert {h: sum(k) for h, k in kept.items()} == {"large": 0, "small": 1, "nineteen": 0, **{f"clean{k}": 29 for k in range(40)}}
    signs = [doc(k, good + " $$$" * 40 if k % 4 else good, source="signs") for k in range(40)] + [doc(100 + k, good, source="plain") for k in range(40)]
    got = {r.doc_id: (r.kept, r.base_failed, r.failed) for r in quality.judge(spark.createDataFrame(signs, SCHEMA)).collect()}
    assert got[0] == (False, False, []) and got[1][1:] == (True, ["repeats", "symbols"]) and got[100] == (True, False, [])
    assert quality.judge(frame(spark, [])).count() == 0


def test_secrets_equal_the_regexes(spark):
    rng = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " = ", ":", "'", '"', "abcdef1", "x", "AKIA" + "B2" * 9, "akia" + "b" * 20, "0f" * 14, "é😀", "\n", "passwd=", "toke", "n"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in secrets.scan(frame(spark, texts)).collect()}
    base = [r for r in secrets.RULES if r.base]
    for k, t in enumerate(texts):
        want = []
        for order, rule in enumerate(base):
            want += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(rule.regex.replace("(?i)", ""), t or "", re.I | re.A if "(?i)" in rule.regex else 0) if len(m[rule.group]) >= rule.least]
        assert [x for x in got[k] if x[1] in {r.kind for r in base}] == [(a, kind, b) for a, _, kind, b in sorted(want)]


def test_trigram_queries():
    by = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert by["hex"] == () and by["access"] == (("aki", "kia"),) and ("ken", "oke", "tok") in by["assign"] and len(by["assign"]) == 6
    own = lambda regex: secrets.trigram_query(secrets.Rule("own", regex))
    assert own("ab+cd") == own("a[bx-z]cd|abc?") == own("(abc)*d") == own("") == own("é日本語") == ()
    assert own("abcd") == (("abc", "bcd"),) == own("a[Bb]cd") == own(r"\ba(?:bc)d(?!x)") and own("abc|abcd") == own("(abc)+d?") == (("abc",),)
    assert own("(?:a|b|c|d|e|f|g)(?:a|b|c|d|e|f|g)(?:a|b|c|d|e|f|g)xyz") == (("xyz",),)  # too many forms: the part gives nothing


def random_regex(rng, depth=0):
    """A regex, and a function that draws a text that it matches."""
    kind = rng.choice(["word", "word", "class", "join", "or", "repeat", "option", "any"] if depth < 3 else ["word", "class"])
    if kind == "word":
        w = "".join(rng.choice("abcDEF-é") for _ in range(rng.randrange(1, 5)))
        return re.escape(w), lambda: w
    if kind == "class":
        c = "".join(rng.sample("abcdefXYZ", rng.randrange(1, 6)))
        return f"[{c}]", lambda: rng.choice(c)
    if kind == "any":
        return ".", lambda: rng.choice("ab .é")
    x, draw_x = random_regex(rng, depth + 1)
    if kind == "repeat":
        low, high = rng.choice([(0, 2), (1, 3), (2, 2), (9, 9)])
        return f"(?:{x}){{{low},{high}}}", lambda: "".join(draw_x() for _ in range(rng.randint(low, high)))
    if kind == "option":
        return f"({x})?", lambda: draw_x() if rng.random() < 0.5 else ""
    y, draw_y = random_regex(rng, depth + 1)
    if kind == "or":
        return f"(?:{x}|{y})", lambda: rng.choice([draw_x, draw_y])()
    return x + y, lambda: draw_x() + draw_y()


def test_trigram_queries_lose_no_match():
    rng, asked = random.Random(15), 0
    for _ in range(1500):
        regex, draw = random_regex(rng)
        regex, text = "(?i)" + regex, draw()
        assert re.search(regex, text)
        query = secrets.trigram_query(secrets.Rule("own", regex))
        text = "".join(rng.choice([c.upper(), c]) if c.isascii() else c for c in text).lower()
        asked += bool(query)
        assert not query or any(all(g in text for g in grams) for grams in query), (regex, text, query)
    assert asked > 150


def test_all_secret_rules_equal_brute_force(spark):
    rng = random.Random(16)
    key = "-----BEGIN RSA PRIVATE KEY-----\nab12\n-----END RSA PRIVATE KEY-----"
    parts = [key, key[:40], "-----BEGIN PRIVATE KEY----------END PRIVATE KEY-----", "eyJ" + "a1" * 9, ".", "eyJhb", "Bearer ", "BEARER  ", "abcDEF123456/+=.-_7890xyz", "bearer", " ", "é", "token: 'abcdefg'", "0f" * 15]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    rows = [doc(k, t) for k, t in enumerate(texts)] + [doc(None, texts[-1]), doc(None, None), doc(7, "x token=secret1"), doc(7, "x token=secret1"), doc(7, "nothing")]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("_low", "_kinds", "_id", "gram", "found")})

    def want(text):
        out = []
        for order, rule in enumerate(secrets.RULES):
            out += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(rule.regex, text or "", re.A) if len(m[rule.group]) >= rule.least]
        return [(a, kind, b) for a, _, kind, b in sorted(out)]

    got = sorted((r.doc_id is None, r.doc_id or 0, [(s.start, s.kind, s.end) for s in r.found]) for r in secrets.scan(clash).collect())
    assert got == sorted((r[0] is None, r[0] or 0, want(r[1])) for r in rows)
    assert secrets.scan(frame(spark, [])).count() == 0


def test_chat_is_read_back(spark):
    rng = random.Random(9)
    bits = ["\\", "\\!", "<</SYS>>", "<<<</SYS>>>", "[INST] x", " [/INST]", "<", "[", "<s", "</s></s>", "[TEXT]", "[ROLE]x[TEXT]", "\n", " ", "$1", "é😀"]
    roles = ["user", "assistant", "system", "", None, "tool[TEXT]", "<s>"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(4))) or None) for c in range(80) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.formatted(table).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), "segments", "formatted").collect()
    for r in got:
        want = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        assert [(x.role, x.text) for x in r.t] == want
        assert "".join(s.segment for s in r.segments) == r.formatted
        assert len([s for s in r.segments if s.loss]) == sum(role == "assistant" for role, _ in want)


def test_chat_turn_order(spark):
    of = lambda *roles: [(hash(roles), k, role, "x") for k, role in enumerate(roles)]
    cases = {("user", "assistant"): True, ("system", "user", "assistant"): True, ("assistant",): False, ("user", "user", "assistant"): False, ("user",): False, ("user", "system", "assistant"): False}
    rows = [r for c in cases for r in of(*c)]
    got = {r.conv_id: r.valid for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {hash(c): ok for c, ok in cases.items()}


def test_chat_query(spark, tables):
    at = tables(conversations=[(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "assistant", None)])
    got = {r.conv_id: r for r in queries.op3_chat_formatting(spark, at).collect()}
    assert set(got) == {1, -7} and got[1].n_turns == 3 and got[1].loss_chars == 2
    turns = "".join(f"{r}\n</s>[INST] ok [/INST]\n" for r in ("user", "assistant"))
    assert got[-7].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


def repeated_windows(texts, words):
    """Windows of whole lines with `words` words or more that occur twice in order, as (text number, lines)."""
    seen, out = set(), []
    for k, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        for i in range(len(lines)):
            total, j = 0, i
            while j < len(lines) and total < words:
                total, j = total + len(lines[j].split()), j + 1
            if total >= words:
                key = tuple(lines[i:j])
                if key in seen:
                    out.append((k, key))
                seen.add(key)
    return out


def test_line_dedup_leaves_no_repeat_and_loses_no_line(spark):
    rng = random.Random(10)
    line = lambda: " ".join(f"v{rng.randrange(900)}" for _ in range(rng.choice((1, 4, 9, 30, 60))))
    passages = [[line() for _ in range(rng.randrange(1, 8))] for _ in range(12)]
    texts = list(ODD)
    for _ in range(80):
        parts = [[line() for _ in range(rng.randrange(4))] + [""] * rng.randrange(2) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(x for p in parts for x in p))
    df = frame(spark, texts).withColumn("runs", F.lit("mine")).withColumn("n_removed", F.lit(-1)).repartition(5)
    rows = {r._row.doc_id: r for r in line_dedup.dedup(df).collect()}
    out = [rows[k]._row.text for k in range(len(texts))]
    assert rows[0]._row.text is None and rows[3]._row.runs == "mine" and rows[3]._row.n_removed == -1
    assert sum(r.n_removed > 0 for r in rows.values()) > 20
    assert repeated_windows(out, line_dedup.WINDOW_WORDS) == []
    left = {x for t in out if t for x in t.split("\n")}
    assert {x for t in texts if t for x in t.split("\n") if x.strip()} <= left
    # Texts without a repeated run of GRAM_WORDS words stay as they are.
    hit = {k for k, _ in repeated_windows(texts, line_dedup.GRAM_WORDS)}
    assert all(out[k] == texts[k] for k in range(len(texts)) if k not in hit)
    assert line_dedup.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_line_dedup_extends_with_any_earlier_occurrence(spark, parts):
    line = lambda k, n: " ".join(f"{k}x{i}" for i in range(n))
    texts, whole, fresh = [], [], []
    for k in range(30):
        g, x, y, z = line(f"g{k}", 50), line(f"x{k}", 20), line(f"y{k}", 20), line(f"z{k}", 20)
        texts += [g, f"{x}\n{g}\n{y}", g, f"{z}\n{g}\n{z} end", g, f"{x}\n{g}\n{y}\nnew{k}"]
        whole += [x, y]
        fresh.append(f"new{k}")
    rows = {r._row.doc_id: r._row.text for r in line_dedup.dedup(frame(spark, texts).repartition(parts)).collect()}
    assert [rows[k] for k in range(5, len(texts), 6)] == fresh
    assert [x for k in range(1, len(texts), 6) for x in rows[k].split("\n")] == whole


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ze", "tu", "pra", "gno") for b in ("ran", "tel", "mos", "vik", "dal", "fex", "hun", "wob")] + [f"r{k}" for k in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [words(rng.randrange(15, 60)) for _ in range(40)]
    texts, truth = list(ODD) + [" ".join(words(rng.randrange(5, 400))) for _ in range(120)], set()
    for k in range(80):
        item = list(items[k % 40])
        for _ in range(len(item) // 6 if k >= 40 else 0):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        truth.add(len(texts))
        texts.append(" ".join(words(rng.randrange(150)) + [w.upper() if k % 3 == 0 else w + "," if k % 3 == 1 else w for w in item] + words(rng.randrange(150))))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(frame(spark, texts), benchmark).collect()}
    exact = {k for k in truth if k - min(truth) < 40}
    assert exact <= got and len(got & truth) >= 0.9 * len(truth) and not got - truth
    assert decontamination.contaminated(frame(spark, texts), benchmark.filter("item_id >= 90")).count() == 0
    assert decontamination.contaminated(frame(spark, []), benchmark).count() == 0


def test_decontamination_finds_verbatim_copies_of_a_full_block(spark):
    rng = random.Random(21)
    words = lambda n: [f"q{rng.randrange(3000)}" for _ in range(n)]
    items = [words(rng.randrange(16, 60)) for _ in range(decontamination.BLOCK_ITEMS)]
    texts = [" ".join(words(rng.randrange(20, 150)) + (items[k] if k % 2 else []) + words(rng.randrange(20, 150))) for k in range(len(items))]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(frame(spark, texts).repartition(4), benchmark).collect()}
    assert len({(k, k) for k in range(1, len(items), 2)} - found) == 0


@pytest.mark.parametrize("share", [3, 1])
def test_decontamination_finds_an_item_that_many_documents_hold(spark, share):
    rng = random.Random(22)
    words = lambda n: [f"q{rng.randrange(20000)}" for _ in range(n)]
    items = [words(n) for n in (8, 15, 20, 40, 60)]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for item in items:
        texts = [" ".join(words(rng.randrange(150)) + (item if k % share == 0 else []) + words(rng.randrange(150))) for k in range(300)]
        assert {r.doc_id for r in decontamination.contaminated(frame(spark, texts), benchmark).collect()} == set(range(0, 300, share))


def test_decontamination_recalls_what_brute_force_finds():
    """Items in part, at every edit rate: all windows and items that LCS and answer words confirm are candidates."""
    rng = random.Random(23)
    words = lambda n: np.array([rng.randrange(2**64) if rng.random() < 0.5 else k * 0x9E3779B97F4A7C15 % 2**64 for k in rng.choices(range(200), k=n)], np.uint64)
    items = [(k, words(rng.randrange(15, 60))) for k in range(decontamination.BLOCK_ITEMS // 8)]
    texts = []
    for k in range(500):
        item = items[k % len(items)][1].copy()
        item[np.array([rng.random() < k % 8 / 14 for _ in item], bool)] = words(1)
        texts.append(np.concatenate((words(rng.randrange(100)), item, words(rng.randrange(100)))))
    hashes, first = np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])
    begin, per = decontamination.passages(first)
    row = np.repeat(np.arange(len(texts)), np.diff(per))
    seen = np.bincount(np.concatenate([np.unique(decontamination.cells(hashes[b : b + 32])) for b in begin]), minlength=decontamination.CELLS)
    index = decontamination.Index(items, np.log((len(begin) + 1) / (seen + 1.0)) + 0.1)
    got = set(zip(row[(c := index.candidates(hashes, begin, row, decontamination.COSINE))[0]].tolist(), c[1].tolist(), strict=True))
    want = set()
    for w, r in enumerate(row):
        i = int(r) % len(items)
        item = items[i][1].tolist()
        text = hashes[max(first[r], begin[w] - len(item)) : min(first[r + 1], begin[w] + 64 + len(item))].tolist()
        if decontamination.lcs(item, text) >= 0.6 * len(item) and len(index.answers[i].intersection(text)) >= 0.5 * len(index.answers[i]):
            want.add((int(r), i))
    assert len(want) > 250 and not want - got


def test_lcs():
    rng = random.Random(12)
    for _ in range(100):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 20))], [rng.randrange(5) for _ in range(rng.randrange(20))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.lcs(a, b) == table[-1][-1]


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.5), ("sf0.1", 0.85)])  # 33 and 305 toxic rows to learn from
def test_toxicity_on_held_out_rows(spark, sf, recall):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").select("doc_id", "toxic")
    out = language_id.fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, labels.filter(~out))
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(out).collect()
    hits = [r for r in rows if r.predicted]
    assert sum(r.toxic for r in hits) >= 0.95 * len(hits) and sum(r.toxic for r in hits) >= recall * sum(r.toxic for r in rows)
    print("held-out", len(hits), sum(r.toxic for r in hits), sum(r.toxic for r in rows))
    odd = toxicity.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_toxicity_without_labels(spark):
    none = toxicity.train(frame(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(frame(spark, ODD), none).collect()} == {0.0}


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(13)
    x = rng.random(300)
    y = (rng.random(300) < x).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    assert abs(np.interp(x, at, value).mean() - y.mean()) < 1e-9


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.fold(F.col("doc_id"), 5) == 0
    model = language_id.train(docs.filter(~out))
    rows = language_id.predict(docs.filter(out), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    odd = {r.doc_id: r for r in language_id.predict(frame(spark, ODD), model).collect()}
    assert all((odd[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for k, t in enumerate(ODD))
    nothing = language_id.train(frame(spark, []))
    assert {r.lang_pred for r in language_id.predict(frame(spark, ["abc"]), nothing).collect()} == {"und"}


def test_pipeline_decisions(spark, tables):
    import corpus_pipeline

    rng = random.Random(14)
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    prose = lambda: " ".join(rng.choice(source[rng.randrange(len(source))].text.split()) for _ in range(80))
    leak, clean, passage = prose(), prose(), prose()
    words = clean.split()
    near = " ".join(words[:40] + ["different"] + words[40:])
    extra = [doc(1000, clean), doc(1001, near), doc(1002, "12 34"), doc(1003, None), doc(1004, f"{prose()} {leak} {prose()}"), doc(1005, f"{prose()}\n{passage}\n{prose()}"), doc(1006, f"{prose()}\n{passage}\n{prose()}"), doc(1007, clean)]
    at = tables(documents=[tuple(r) for r in source] + extra, benchmark=[(1, leak)])
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/out{k}")
        docs = spark.read.parquet(f"{at}/out{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not {1002, 1003} & kept[0].keys() and {1000, 1001, 1004} <= kept[0].keys()
    assert passage in kept[1][1005].text and passage not in kept[1][1006].text and kept[1][1006].n_chars == len(kept[1][1006].text)
    assert 1000 in kept[2] and not {1001, 1007} & kept[2].keys()
    assert 1004 not in kept[3] and {1000, 1005, 1006} <= kept[3].keys()
    assert kept[4].keys() == kept[3].keys()
