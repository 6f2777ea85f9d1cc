"""Cross-tokenizer alignment against the libraries, text by text."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import doc
from tests.llm.test_operators import ODD, SCHEMA, frame
from veilstone.llm import alignment, arrays, queries

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    sign = alignment.byte_level()
    out, links = [], []
    for text in texts:
        a, b = left.encode(" " + (text or ""), add_special_tokens=False).ids, right.encode(text or "")
        spelled_a = [bytes(sign[c] for c in left.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if right.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [right.id_to_piece(i)]]
        if not text or not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            out.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = []
        for spelled in (spelled_a, spelled_b):
            at = 0
            ends.append([at := at + len(s) for s in spelled])
        both = sorted(set(ends[0]) & set(ends[1]))
        written, begin = [], 0
        for e in both:
            written.append("|".join(",".join(str(i) for i, x in zip(ids, at, strict=True) if begin < x <= e) for ids, at in zip((a, b), ends, strict=True)))
            begin = e
        out.append((len(a), len(b), len(both), hashlib.sha256(";".join(written).encode()).hexdigest()))
        links.append([(i, j) for i, x in zip(a, ends[0], strict=True) if x in set(both) for j, y in zip(b, ends[1], strict=True) if x == y])
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, n, len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), sha) for (n_a, n_b, n, sha), own in zip(out, links, strict=True)], counts, best


def some_texts():
    rng = random.Random(31)
    odd = [*ODD, "<|endoftext|> a<s>b</s> <unk>", "▁x", "a\nb\n\nc d  e\r\n", "x y　z \u0085", "été à la plage", "日本語 abc 日本語", "don't it's we'll", "a\x00b \x7f", "1234567 89,0", " lead", "trail ", "\n", "\n\nx", "é o", "😀😀 👍🏽", "ab" * 3000]
    words = ["the", "Cat", "sat,", "naïve", "(x)", "don't", "12.5", "Ünder", "日本", "a\nb", "co-op", "ÀÉ", "…"]
    return odd + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\n\n", "\t", " "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["".join(rng.choice("ab é▁\n 日x'st.") for _ in range(rng.randrange(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("units", [40, 1 << 18])
def test_alignment_equals_the_libraries(spark, monkeypatch, units):
    monkeypatch.setattr(alignment, "BLOCK_UNITS", units)  # many blocks, or one
    monkeypatch.setattr(alignment, "CELLS", 50)
    texts = some_texts()
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(frame(spark, texts), A, B).collect()}
    want, counts, best = brute(texts)
    assert [got[k] for k in range(len(texts))] == [(a, b, g, n, x, c, s) for a, b, g, n, x, c, s in want]
    pairs = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(frame(spark, texts), A, B).collect()}
    assert pairs == {p: (n, n == best[p[1]]) for p, n in counts.items()}
    written = {r.doc_id: r.groups for r in alignment.groups(frame(spark, texts), A, B).collect()}
    assert [hashlib.sha256(written[k].encode()).hexdigest() if written[k] else "" for k in range(len(texts))] == [w[6] for w in want]


def test_units_tile_the_texts():
    texts = some_texts()
    data, offsets = alignment.blanked(*arrays.utf8(pa.array(texts)))
    cuts, first = alignment.unit_cuts(data, offsets)
    for k, text in enumerate(texts):
        own = [bytes(data[x:y]) for x, y in zip(cuts[first[k] : first[k + 1]], cuts[first[k] + 1 : first[k + 1] + 1], strict=True)]
        assert b"".join(own) == ((" " + text).encode() if text else b"") and all(own)


def test_alignment_of_odd_rows(spark):
    rows = [doc(1, "the cat sat"), doc(1, "the cat sat"), doc(None, "the dog"), doc(None, None), doc(3, "")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("block", "stripe", "kind", "pairs", "counts", "n_a", "size", "at")})
    got = sorted((r.doc_id or -1, r.n_a, r.n_links, r.count_sum) for r in alignment.align(table, A, B).collect())
    want = sorted((r[0] or -1, w[0], w[3], w[5]) for r, w in zip(rows, brute([r[1] for r in rows])[0], strict=True))
    assert got == want
    assert alignment.align(table.limit(0), A, B).count() == 0 and alignment.pair_counts(table.limit(0), A, B).count() == 0


def test_alignment_of_texts_over_a_slice(spark):
    rng = random.Random(32)
    words = ["".join(rng.choice("aeiourstlnm") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = ["short", " ".join(rng.choice(words) for _ in range(400_000)), "tail end"]
    assert len(texts[1]) > arrays.SLICE_BYTES
    got = {r.doc_id: (r.n_a, r.n_b, r.n_links) for r in alignment.align(frame(spark, texts).coalesce(1), A, B).collect()}
    import sentencepiece
    from tokenizers import Tokenizer

    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    for k, text in enumerate(texts):
        assert got[k][:2] == (len(left.encode(" " + text, add_special_tokens=False).ids), len(right.encode(text)))


def test_query_op13_covers_all_documents(spark, tables):
    at = tables(documents=[doc(k, t) for k, t in enumerate(some_texts()[:40])])
    rows = queries.QUERIES["op13_token_alignment"](spark, at).collect()
    want, _, _ = brute(some_texts()[:40])
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows} == dict(enumerate(want))
