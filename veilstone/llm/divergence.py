"""Source divergence audit: how far the word frequencies of each language's sources lie from each other.

Partitions count terms in radix tries whose leaves hold a counter for each source. A trie is held flat, in the order of
its traversal: each leaf has the number of bytes that it shares with the leaf before it, and the labels from there on.
Bytes of UTF-8 sort as its code points, so the traversal is in the order of terms. Partitions keep their tries as rows of
some leaves; rows are then cut at common prefixes, and the pieces of one prefix range are merged in one task, piece by
piece. The merged tries are traversed once more, with the totals of each group known: pair sums and each group's best
candidates stream out of the traversal and are added up by Spark.

All arithmetic is of integers; nothing is sampled but the prefixes at which ranges are cut, on which no result depends.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

SCALE = 1_000_000_000
#: Different terms that a partition's tries hold before they are written; counters that a trie holds before they are added up.
MOST_TERMS, MOST_COUNTERS = 1 << 18, 1 << 19
#: Leaves to a row; leaves of all partitions to a prefix range; rows drawn for each range's end; bytes of a cut.
ROW_LEAVES, RANGE_LEAVES, DRAWN, CUT_BYTES = 1024, 1 << 18, 16, 24
#: Cells of a matrix of sources by terms that are computed at a time.
MOST_CELLS = 1 << 20
#: Rows that a task is handed at a time: of documents, of tries.
BATCH_DOCS, BATCH_ROWS = 1024, 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

TRIE_DDL = "lang string, first binary, leaves long, shared binary, sizes binary, labels binary, docs binary, held binary, source binary, counts binary, sources array<string>"
TRIE = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("leaves", pa.int64()), *((n, pa.binary()) for n in ("shared", "sizes", "labels", "docs", "held", "source", "counts")), ("sources", pa.list_(pa.string()))])


class Trie:
    """A mergeable radix trie of byte strings; leaves hold in how many documents a term occurs and its count by source."""

    def __init__(self) -> None:
        self.leaf: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.docs, self.n_waiting, self.n_added = np.zeros(64, np.int64), 0, 0

    def leaves(self, terms: list[bytes]) -> np.ndarray:
        """The leaves of the terms, put in where they are new."""
        leaf = self.leaf
        at = np.array([leaf.setdefault(t, len(leaf)) for t in terms], np.int64)
        while len(leaf) > len(self.docs):
            self.docs = np.concatenate((self.docs, np.zeros_like(self.docs)))
        return at

    def add(self, leaf: np.ndarray, docs: np.ndarray, counted: np.ndarray, source: list[str], which: np.ndarray, counts: np.ndarray) -> None:
        """docs[k] documents hold leaf[k]; counts[k] occurrences of leaf counted[k] are of source[which[k]]."""
        np.add.at(self.docs, leaf, docs)
        own = np.array([self.sources.setdefault(s, len(self.sources)) for s in source], np.int64)
        self.waiting.append((counted << 24 | own[which], counts))
        self.n_waiting += len(counts)
        if self.n_waiting > max(MOST_COUNTERS, self.n_added):  # by then as many are new as added up, so sorting stays in proportion
            self.waiting = [self.counters()]
            self.n_waiting, self.n_added = 0, len(self.waiting[0][0])

    def counters(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and source as one number, ascending, and the count."""
        keys, where = np.unique(np.concatenate([k for k, _ in self.waiting] + [np.zeros(0, np.int64)]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate([c for _, c in self.waiting] + [np.zeros(0, np.int64)]))
        return keys, total

    def merge(self, row: dict) -> None:
        """Add a written piece of another trie."""
        leaf = self.leaves(read_terms(row["shared"], row["sizes"], row["labels"]))
        docs, held, source, counts = (np.frombuffer(row[n], t) for n, t in (("docs", np.int64), ("held", np.int32), ("source", np.int32), ("counts", np.int64)))
        self.add(leaf, docs, np.repeat(leaf, held), row["sources"], source, counts)

    def rows(self, lang: str, least: int = 0, size: int = ROW_LEAVES) -> Iterator[tuple]:
        """Rows of `size` leaves, in the order of the traversal; leaves in fewer than `least` documents are left out."""
        keys, counts = self.counters()
        terms = list(self.leaf)
        starts = np.searchsorted(keys, np.arange(len(terms) + 1, dtype=np.int64) << 24)
        names = list(self.sources)
        order = [k for k in sorted(range(len(terms)), key=terms.__getitem__) if self.docs[k] >= least]
        for a in range(0, len(order), size):
            own = np.array(order[a : a + size])
            held = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            some, source = np.unique(keys[at] & 0xFFFFFF, return_inverse=True)
            shared, sizes, labels = write_terms([terms[k] for k in own.tolist()])
            yield lang, terms[own[0]], len(own), shared.tobytes(), sizes.tobytes(), labels, self.docs[own].tobytes(), held.astype(np.int32).tobytes(), source.astype(np.int32).tobytes(), counts[at].tobytes(), [names[k] for k in some.tolist()]


def write_terms(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of ascending terms: the bytes shared with the term before, the bytes of the label behind them, and all labels."""
    sizes = np.array([len(t) for t in terms], np.int64)
    data, begin = np.frombuffer(b"".join(terms), np.uint8), np.cumsum(sizes) - sizes
    shared = np.zeros(len(terms), np.int32)
    active = np.arange(1, len(terms))
    depth = 0
    while active.size:
        active = active[(sizes[active] > depth) & (sizes[active - 1] > depth)]
        active = active[data[begin[active] + depth] == data[begin[active - 1] + depth]]
        depth += 1
        shared[active] = depth
    labels = b"".join([t[s:] for t, s in zip(terms, shared.tolist(), strict=True)])
    return shared, (sizes - shared).astype(np.int32), labels


def read_terms(shared: bytes, sizes: bytes, labels: bytes) -> list[bytes]:
    terms, term, at = [], b"", 0
    for s, n in zip(np.frombuffer(shared, np.int32).tolist(), np.frombuffer(sizes, np.int32).tolist(), strict=True):
        term = term[:s] + labels[at : at + n]
        terms.append(term)
        at += n
    return terms


def _batch(rows: list[tuple], schema: pa.Schema = TRIE) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def count(docs: DataFrame) -> DataFrame:
    """Tries of each partition and language, in rows of some leaves."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = {}

        def out() -> Iterator[pa.RecordBatch]:
            while tries:
                lang, trie = tries.popitem()
                rows = trie.rows(lang)
                while some := list(islice(rows, 64)):
                    yield _batch(some)
                del trie, rows
            arrays.trim()

        for batch in batches:
            langs, sources = (batch.column(k).fill_null("") for k in (1, 2))
            for a, b, data, offsets in arrays.text_slices(batch.column(0)):
                rows_lang = langs.slice(a, b - a).dictionary_encode()
                rows_source = sources.slice(a, b - a).dictionary_encode()
                lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (rows_lang, rows_source))
                names = rows_source.dictionary.to_pylist()
                starts, ends, first = arrays.word_spans(data, offsets, _LETTER)
                held = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(held), pa.py_buffer(_LOWER[data[_LETTER[data]]])]).dictionary_encode()
                terms, term = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(b - a), np.diff(first))
                for k, lang in enumerate(rows_lang.dictionary.to_pylist()):
                    mine = lang_of[row] == k
                    if not mine.any():
                        continue
                    trie = tries.setdefault(lang, Trie())
                    some, local = np.unique(term[mine], return_inverse=True)
                    leaf = trie.leaves([terms[t] for t in some.tolist()])
                    once = np.unique(row[mine] * len(some) + local) % len(some)
                    pair, counts = np.unique(local * len(names) + source_of[row[mine]], return_counts=True)
                    trie.add(leaf, np.bincount(once, minlength=len(some)), leaf[pair // len(names)], names, pair % len(names), counts)
                if sum(len(t.leaf) for t in tries.values()) > MOST_TERMS:
                    yield from out()
        yield from out()

    return docs.select("text", "lang", "source").mapInArrow(scan, TRIE_DDL)


def cuts(tries: DataFrame) -> list[tuple[str, bytes]]:
    """Ends of prefix ranges, each of about RANGE_LEAVES leaves or a task's share: prefixes of drawn rows' first terms."""
    spark = tries.sparkSession
    rows, leaves = tries.agg(F.count("*"), F.coalesce(F.sum("leaves"), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, -(-leaves // RANGE_LEAVES))
    share = min(1.0, DRAWN * ranges / max(rows, 1))
    drawn = sorted((r.lang, bytes(r.first)) for r in tries.select("lang", F.substring("first", 1, CUT_BYTES).alias("first")).sample(fraction=share, seed=1).collect())
    return sorted({drawn[k * len(drawn) // ranges] for k in range(ranges)}) if drawn else []


def merge(tries: DataFrame, least: int) -> DataFrame:
    """The tries merged by prefix range; terms in at least `least` documents stay."""
    ends = cuts(tries)
    shared = tries.sparkSession.sparkContext.broadcast(ends)
    names = [f.name for f in TRIE]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with the number of its range; a row that reaches over an end is cut there."""
        ends, schema = shared.value, TRIE.append(pa.field("range", pa.int32()))
        for batch in batches:
            out = []
            for k in range(len(batch)):
                row = {n: batch.column(n)[k].as_py() for n in names}
                lang, terms = row["lang"], None
                at, stop = bisect_right(ends, (lang, row["first"])), len(ends)
                if at < stop and ends[at][0] == lang:
                    terms = read_terms(row["shared"], row["sizes"], row["labels"])
                if terms is None or (lang, terms[-1]) < ends[at]:
                    out.append((*row.values(), at))
                else:
                    docs, held, source, counts = (np.frombuffer(row[n], t) for n, t in (("docs", np.int64), ("held", np.int32), ("source", np.int32), ("counts", np.int64)))
                    begin, x = np.concatenate(([0], np.cumsum(held))), 0
                    while x < len(terms):
                        y = bisect_left(terms, ends[at][1], x) if at < stop and ends[at][0] == lang else len(terms)
                        if y > x:
                            one, two, labels = write_terms(terms[x:y])
                            own = slice(begin[x], begin[y])
                            out.append((lang, terms[x], y - x, one.tobytes(), two.tobytes(), labels, docs[x:y].tobytes(), held[x:y].tobytes(), source[own].tobytes(), counts[own].tobytes(), row["sources"], at))
                        x, at = y, at + 1
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie()
        for batch in batches:
            for k in range(len(batch)):
                key = batch.column("range")[k].as_py(), batch.column("lang")[k].as_py()
                if key != now:
                    for row in trie.rows(now[1], least) if now else ():
                        yield _batch([row])
                    now, trie = key, Trie()
                    arrays.trim()
                trie.merge({n: batch.column(n)[k].as_py() for n in names})
        for row in trie.rows(now[1], least) if now else ():
            yield _batch([row])
        del trie
        arrays.trim()

    pieces = tries.mapInArrow(cut, TRIE_DDL + ", range int")
    return pieces.repartition("range").sortWithinPartitions("range", "lang").mapInArrow(fold, TRIE_DDL)


def share(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division: exact for counts up to 2^53."""
    whole, rest = np.divmod(counts.astype(np.int64) + 2, np.int64(total + 2 * kept))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(total + 2 * kept))
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


FOUND_DDL = "lang string, source string, part string, item string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _totals(merged: DataFrame) -> DataFrame:
    """Of each merged row: occurrences by source, and under a null source the number of terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(n)[k].as_py() for n in ("lang", "leaves", "source", "counts", "sources")}
                by = np.zeros(len(row["sources"]), np.int64)
                np.add.at(by, np.frombuffer(row["source"], np.int32), np.frombuffer(row["counts"], np.int64))
                for s, n in [*zip(row["sources"], by.tolist(), strict=True), (None, row["leaves"])]:
                    seen[row["lang"], s] = seen.get((row["lang"], s), 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "source", "n"])

    return merged.mapInArrow(scan, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))


def _traverse(merged: DataFrame, groups: dict[str, tuple[list[str], list[int], int]], ranks: int) -> DataFrame:
    """Pair sums and best candidates of the merged tries' terms; a row for each task and pair, `ranks` for each group."""
    shared = merged.sparkSession.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, np.ndarray] = {}
        best: dict[tuple[str, int], list[tuple[int, bytes]]] = {}
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(n)[k].as_py() for n in ("lang", "shared", "sizes", "labels", "held", "source", "counts", "sources")}
                lang = row["lang"]
                names, totals, kept = shared.value[lang]
                place = {s: j for j, s in enumerate(names)}
                which = np.array([place[s] for s in row["sources"]], np.int64)[np.frombuffer(row["source"], np.int32)]
                terms, counts, held = read_terms(row["shared"], row["sizes"], row["labels"]), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["held"], np.int32)
                begin = np.concatenate(([0], np.cumsum(held)))
                sums = pairs.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
                step = max(1, MOST_CELLS // len(names))
                for a in range(0, len(terms), step):
                    own = terms[a : a + step]
                    used = slice(begin[a], begin[a + len(own)])
                    table = np.zeros((len(names), len(own)), np.int64)
                    table[which[used], np.repeat(np.arange(len(own)), held[a : a + step])] = counts[used]
                    p = np.stack([share(table[j], totals[j], kept) for j in range(len(names))])
                    q = share(table.sum(0), sum(totals), kept)
                    for j in range(len(names)):
                        sums[j, j + 1 :] += apart(p[j], p[j + 1 :]).sum(1)
                        value = np.where((table[j] > 0) & (p[j] > q), apart(p[j], q), -1)
                        order = np.argsort(-value, kind="stable")[:ranks]  # terms ascend, so equal values keep their order
                        found = best.setdefault((lang, j), [])
                        found += [(-int(value[t]), own[t]) for t in order.tolist() if value[t] >= 0]
                        found.sort()
                        del found[ranks:]
        out = [(lang, shared.value[lang][0][j], "pair", shared.value[lang][0][i], int(x[min(i, j), max(i, j)])) for lang, x in pairs.items() for j in range(len(x)) for i in range(len(x)) if i != j]
        out += [(lang, shared.value[lang][0][j], "term", t.decode(), -v) for (lang, j), found in best.items() for v, t in found]
        for a in range(0, len(out), 10_000):
            yield _batch(out[a : a + 10_000], _FOUND)

    return merged.mapInArrow(scan, FOUND_DDL)


def audit(docs: DataFrame, least: int = 10, ranks: int = 10, scope: str = "query") -> DataFrame:
    """lang, source, part, item, value, rank: of each (lang, source) group the divergence from every other source of the
    language (part `pair`) and the `ranks` terms that it uses more than its language does (part `term`).

    A language keeps the terms that are in at least `least` of its rows. Null texts, languages and sources are ''.
    Repeated rows count each; a group without terms still has its pairs, of value 0 where its language keeps no term; ids
    and other columns are ignored; an empty table gives no row. Equal values are ranked by item.
    What is broadcast has an entry for each group; the result has one for each pair of them.
    """
    docs = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    tries = store.keep(count(docs), scope, BATCH_DOCS)
    merged = store.keep(merge(tries, least), scope, BATCH_ROWS)
    store.discard(tries)
    occurring = store.keep(docs.select("lang", "source").distinct(), scope)
    told = {(r.lang, r.source): r.n for r in _totals(merged).collect()}
    names: dict[str, list[str]] = {}
    for r in occurring.collect():
        names.setdefault(r.lang, []).append(r.source)
    groups = {lang: (sorted(own), [told.get((lang, s), 0) for s in sorted(own)], told.get((lang, None), 0)) for lang, own in names.items()}
    found = store.keep(_traverse(merged, groups, ranks), scope, BATCH_ROWS)
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = occurring.select(F.col("lang").alias("_lang"), F.col("source").alias("item"))
    pairs = occurring.join(other, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("item"))).drop("_lang").join(sums, ["lang", "source", "item"], "left")
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")).unionByName(found.filter("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return both.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
