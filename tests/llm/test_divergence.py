"""The divergence audit against a plain count of all terms, and its tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import doc
from tests.llm.test_operators import ODD, SCHEMA
from veilstone.llm import divergence, oracles, queries, store

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, ranks=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        used = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        used[None] = {t: sum(u[t] for u in used.values()) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (n + 2) // (sum(u.values()) + 2 * len(kept)) for t, n in u.items()} for s, u in used.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], p[None][t])) for t in kept if used[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, ranks)):
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def some_rows(seed=41, n=300):
    rng = random.Random(seed)
    words = ["The", "cat", "été", "Über", "日本", "x1y", "naïve", "ab_c", "ÀB", "z", "zz", "zzz", "😀", "a-b", *(f"{rng.choice('abcé')}{rng.choice('xyz')}{rng.choice('mnopü')}" for _ in range(60))]
    rows = [doc(k, " ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", "é", None])) for k in range(n)]
    return rows + rows[:20] + [doc(900 + k, t, "odd", "s1") for k, t in enumerate(ODD)] + [doc(None, "the cat", "en", "only"), doc(None, None, None, None), doc(5, None, "en", "silent"), doc(6, "123 456", "none", "a"), doc(7, "", "none", "b")]


def collected(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_counts(spark, monkeypatch, small):
    if small:  # tries are written early, rows are short, ranges many, matrices narrow
        for name, value in (("MOST_TERMS", 20), ("MOST_COUNTERS", 30), ("ROW_LEAVES", 7), ("RANGE_LEAVES", 10), ("MOST_CELLS", 12), ("CUT_BYTES", 2)):
            monkeypatch.setattr(divergence, name, value)
    rows = some_rows()
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collected(divergence.audit(table)) == brute(rows)
    assert collected(divergence.audit(table, least=1, ranks=3)) == brute(rows, 1, 3)


def test_audit_of_odd_tables(spark):
    table = spark.createDataFrame(some_rows(42, 60), SCHEMA).withColumns({c: F.lit("x") for c in ("first", "range", "leaves", "item", "value", "rank", "part", "sources")})
    assert collected(divergence.audit(table)) == brute(some_rows(42, 60))
    assert divergence.audit(table.limit(0)).count() == 0
    alone = spark.createDataFrame([doc(1, "a b c")], SCHEMA)
    assert divergence.audit(alone).count() == 0 and len(collected(divergence.audit(alone, least=1))) == 0
    several = spark.createDataFrame([doc(1, "12", "en", "a"), doc(2, None, "en", "b")], SCHEMA)
    assert collected(divergence.audit(several)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_long_texts_and_terms(spark):
    rng = random.Random(43)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta"]) for _ in range(450_000))
    rows = [doc(1, long, "en", "a"), doc(2, "é" * 100_000 + " alpha", "en", "b"), doc(3, "é" * 100_000 + "x beta", "en", "b")]
    assert collected(divergence.audit(spark.createDataFrame(rows, SCHEMA).coalesce(1), least=1)) == brute(rows, 1)


def test_tries_merge_as_dictionaries():
    rng = random.Random(44)
    want, docs, whole = Counter(), Counter(), divergence.Trie()
    for _ in range(6):
        part = divergence.Trie()
        for _ in range(4):
            terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))).encode() for _ in range(40)})
            leaf, names = part.leaves(terms), [rng.choice(["s", "t"]), "u"]
            counts = np.array([rng.randrange(1, 9) for _ in range(2 * len(terms))])
            part.add(leaf, np.ones(len(terms), np.int64), np.repeat(leaf, 2), names, np.tile([0, 1], len(terms)), counts)
            docs.update(terms)
            for k, n in enumerate(counts.tolist()):
                want[terms[k // 2], names[k % 2]] += n
        for row in part.rows("en", size=9):
            whole.merge({f.name: v for f, v in zip(divergence.TRIE, row, strict=True)})
    got, order = Counter(), []
    for row in whole.rows("en", size=11):
        r = {f.name: v for f, v in zip(divergence.TRIE, row, strict=True)}
        terms = divergence.read_terms(r["shared"], r["sizes"], r["labels"])
        order += terms
        at = 0
        for t, n, d in zip(terms, np.frombuffer(r["held"], np.int32).tolist(), np.frombuffer(r["docs"], np.int64).tolist(), strict=True):
            assert d == docs[t]
            for j in range(at, at + n):
                got[t, r["sources"][np.frombuffer(r["source"], np.int32)[j]]] += int(np.frombuffer(r["counts"], np.int64)[j])
            at += n
    assert got == want and order == sorted(docs)


def test_shares_are_exact():
    rng = random.Random(45)
    for _ in range(300):
        kept, counts = rng.randrange(1, 10**6), np.array([rng.randrange(0, 10 ** rng.randrange(1, 14)) for _ in range(5)])
        total = int(counts.sum()) + rng.randrange(0, 10**12)
        assert divergence.share(counts, total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts.tolist()]


def test_query_op11_covers_all_documents(spark, tables):
    rows = some_rows(46, 120)
    assert collected(queries.QUERIES["op11_source_divergence"](spark, tables(documents=rows))) == brute(rows)


def many_terms():
    n = 140 * divergence.ROW_LEAVES
    terms = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(n)]
    return n, [doc(k, " ".join(terms[k % 2 :: 1 + k % 2]), "en", f"s{k % 3}") for k in range(20)]


def test_a_partition_writes_all_its_rows(spark):
    """Rows go out in blocks of 64; none may be lost between two blocks."""
    n, rows = many_terms()
    assert divergence.count(spark.createDataFrame(rows[:2], SCHEMA).coalesce(1)).agg(F.sum("leaves")).first()[0] == n


def test_query_op11_equals_its_sql_on_many_terms(spark, tables):
    at = tables(documents=many_terms()[1])
    with duckdb.connect() as con:
        con.sql(f"create view documents as from read_parquet('{at}/documents.parquet/*.parquet')")
        want = con.sql(oracles.DIVERGENCE).fetchall()
    assert collected(queries.QUERIES["op11_source_divergence"](spark, at)) == sorted(want)


def test_query_op11_equals_its_sql_on_large_vocabularies(spark, tables):
    """Two languages, each with more terms in a partition than a block of rows holds; some terms are in too few documents."""
    rng, rows = random.Random(47), []
    for lang in ("en", None):
        terms = ["".join(rng.choice("abcdéßж日😀") for _ in range(6)) + "xy"[k % 2] for k in range(70 * divergence.ROW_LEAVES)]
        for k in range(12):
            some = terms[: len(terms) * (12 - k % 4) // 12] + rng.choices(terms, k=20_000)
            rows.append(doc(k, rng.choice(" 1_\n").join(some), lang, ["s1", "é", None][k % 3]))
    at = tables(documents=rows)
    with duckdb.connect() as con:
        con.sql(f"create view documents as from read_parquet('{at}/documents.parquet/*.parquet')")
        want = con.sql(oracles.DIVERGENCE).fetchall()
    assert collected(queries.QUERIES["op11_source_divergence"](spark, at)) == sorted(want)


def test_memory_of_tries_and_batches_is_bounded(spark):
    trie = divergence.Trie()
    leaf = trie.leaves([b"a"])
    for _ in range(40):
        trie.add(leaf, np.ones(1, np.int64), np.repeat(leaf, 1 << 15), ["s"], np.zeros(1 << 15, np.int64), np.ones(1 << 15, np.int64))
        assert sum(len(k) for k, _ in trie.waiting) <= (1 << 19) + 1  # what is added up is one counter
    assert trie.counters()[1].tolist() == [40 << 15]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], names=["n"])

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = store.keep(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), "batches", 8)
    assert sorted(r.n for r in kept.collect()) == [4] + [8] * 12
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == held
    store.release(spark, "batches")
