"""Benchmark decontamination by TF-IDF retrieval.

Documents are cut into passages of STEP words; words are hashed into cells and weighted by inverse passage frequency,
counted over all documents. Two neighbouring passages are a window; windows whose cosine with an item reaches a
threshold are candidates, and so are windows that hold most of an item's weight: how much else they hold, and how often
the item was copied, does not matter then. Of a short item that is the least weight that a match can have, so none is lost. The cosine is that of the whole rows and no projection is taken: a latent space that spans
every item gives the same cosines, and one that does not loses items. Of each candidate the longest common subsequence
with the item is taken over the words around the window, and the item's answer has to be there: its words of highest
weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.llm import arrays

CELLS = 1 << 16
STEP = 32
#: Items searched for at a time; what is broadcast follows it and MAX_ITEM_WORDS, not the benchmark.
BLOCK_ITEMS = 2000
#: A longer item is cut into pieces of so many words, each searched for.
MAX_ITEM_WORDS = 256
#: Cells of most items, whose products are taken by a matrix product; and how many products are held at a time.
DENSE_CELLS, PRODUCTS = 256, 1 << 20
COSINE, LCS, ANSWER = 0.25, 0.6, 0.5
#: A window that holds this share of an item's squared weight is a candidate at any cosine. An item of fewer than SHORT words
#: is matched by few words, of which that share may not be left: for these the least weight of any match counts instead.
WHOLE, SHORT = 0.6, 12

_VALUES = arrays.byte_values(21, fold_case=True, zero=tuple(b for b in range(128) if not chr(b).isalnum()))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (case and signs at their end don't count) and the number of each text's first word."""
    starts, _, first = arrays.word_spans(data, offsets)
    return arrays.unit_hashes(data, starts, _VALUES), first


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of all passages, and the number of each text's first passage."""
    per = -(-np.diff(first) // STEP)
    row = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return first[row] + nth * STEP, np.concatenate(([0], np.cumsum(per)))


def passage_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each cell occurs, and the number of passages; a table of fixed size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(CELLS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in arrays.text_slices(batch.column(0)):
                hashes, first = words(data, offsets)
                begin, _ = passages(first)
                passage = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(hashes))))
                keys = passage * CELLS + cells(hashes)
                keys.sort()
                new = np.ones(len(keys), bool)
                new[1:] = keys[1:] != keys[:-1]
                seen += np.bincount(keys[new] & (CELLS - 1), minlength=CELLS)
                n += len(begin)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.astype("<i8").tobytes(), 1)], pa.binary()), pa.array([n])], names=["seen", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen, n = seen + np.frombuffer(zlib.decompress(s), "<i8"), n + k
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([n])], names=["seen", "n"])

    table, parts = docs.select("text").mapInArrow(scan, "seen binary, n long"), docs.rdd.getNumPartitions()
    while parts > 32:
        parts = -(-parts // 32)
        table = table.repartition(parts).mapInArrow(add, "seen binary, n long")
    rows = table.collect()  # 32 rows of one table each at most
    return sum((np.frombuffer(zlib.decompress(r.seen), "<i8") for r in rows), np.zeros(CELLS, np.int64)), sum(r.n for r in rows)


class Index:
    """Items by the cells that they hold. `dense_of`: place of a cell among those of most items, or -1."""

    def __init__(self, items: list[tuple[int, np.ndarray]], idf: np.ndarray, least_lcs: float = LCS, answer: float = ANSWER):
        self.idf = idf.astype(np.float32)
        self.items = items
        own = np.repeat(np.arange(len(items)), [len(w) for _, w in items])
        pair, count = np.unique(np.concatenate([cells(w) for _, w in items] + [np.zeros(0, np.int64)]) * max(len(items), 1) + own, return_counts=True)
        cell, item = np.divmod(pair, max(len(items), 1))
        self.norm = np.sqrt(np.bincount(item, np.square(count * idf[cell]), len(items)))
        self.answers = [answer_words(w, idf) for _, w in items]
        least = [least_weight(w, a, idf, least_lcs, answer) if len(w) < SHORT else np.inf for (_, w), a in zip(items, self.answers, strict=True)]
        self.whole = np.minimum(WHOLE * np.square(self.norm), least)
        value = count * np.square(idf[cell])
        held = np.bincount(cell, minlength=CELLS)
        most = np.argsort(-held, kind="stable")[:DENSE_CELLS]
        most = most[held[most] > 1]
        self.dense_of = np.full(CELLS, -1, np.int32)
        self.dense_of[most] = np.arange(len(most))
        self.dense = np.zeros((len(most), len(items)), np.float32)
        in_dense = self.dense_of[cell] >= 0
        self.dense[self.dense_of[cell[in_dense]], item[in_dense]] = value[in_dense]
        self.item, self.value = item[~in_dense], value[~in_dense]
        self.start = np.searchsorted(cell[~in_dense], np.arange(CELLS + 1))

    def products(self, c: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """Scalar products of the TF-IDF rows of n passages with those of all items; cell c[k] is in passage[k]."""
        place = self.dense_of[c]
        often = place >= 0
        size = len(self.dense)
        out = np.bincount(passage[often] * size + place[often], minlength=n * size).reshape(n, size).astype(np.float32) @ self.dense
        some = np.flatnonzero(self.start[c + 1] > self.start[c])
        begin, count = self.start[c[some]], self.start[c[some] + 1] - self.start[c[some]]
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        key = np.repeat(passage[some] * len(self.items), count) + self.item[at]
        return out + np.bincount(key, self.value[at], n * len(self.items)).reshape(n, -1)

    def candidates(self, hashes: np.ndarray, begin: np.ndarray, block_of: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Windows (by their first passage) and items whose cosine reaches the threshold, or that hold the item nearly whole."""
        n = len(begin)
        out_w, out_i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not n or not self.items:
            return out_w[0], out_i[0]
        c = cells(hashes)
        weight = self.idf[c]
        end = np.append(begin[1:], len(hashes))
        passage = np.repeat(np.arange(n), end - begin)
        norm = np.bincount(passage, weight * weight, n)
        pair = np.append(block_of[1:] == block_of[:-1], False)
        norm[:-1] += norm[1:] * pair[:-1]
        step = max(1, PRODUCTS // len(self.items))
        for a in range(0, n, step):
            b = min(a + step, n)
            last = min(b + 1, n)  # the window of passage b - 1 holds passage b
            used = slice(begin[a], end[last - 1])
            both = self.products(c[used], passage[used] - a, last - a)
            both[:-1] += both[1:] * pair[a : last - 1, None]
            w, i = np.nonzero(both[: b - a] >= self.least(norm[a:b], cosine))
            out_w.append(w + a)
            out_i.append(i)
        return np.concatenate(out_w), np.concatenate(out_i)

    def least(self, norm: np.ndarray, cosine: float) -> np.ndarray:
        """The scalar product from which a window (of this squared norm) and an item are candidates."""
        return np.maximum(np.minimum(cosine * np.sqrt(norm)[:, None] * self.norm, self.whole), 1e-9)


def answer_words(hashes: np.ndarray, idf: np.ndarray) -> set[int]:
    """The quarter of an item's distinct words that weigh most, one at least."""
    unique = np.unique(hashes)
    order = np.lexsort((unique, -idf[cells(unique)]))
    return {int(w) for w in unique[order[: max(1, len(unique) // 4)]]}


def least_weight(hashes: np.ndarray, answers: set[int], idf: np.ndarray, least_lcs: float, answer: float) -> float:
    """The least scalar product of an item and a window that holds a match: the lightest answer words that it needs, and the
    lightest other words up to the length that it needs."""
    weight = np.square(idf[cells(hashes)])
    _, first = np.unique(hashes, return_index=True)
    told = np.isin(hashes[first], np.fromiter(answers, np.uint64, len(answers)))
    needed = np.sort(weight[first[told]])[: max(0, math.ceil(answer * len(answers) - 1e-9))]
    others = np.delete(np.sort(weight), np.searchsorted(np.sort(weight), needed))
    rest = max(0, math.ceil(least_lcs * len(hashes) - 1e-9) - len(needed))
    return float(needed.sum() + others[:rest].sum()) * (1 - 1e-4)  # products are of single precision


def lcs(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a machine word of the table's row at a time."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        m = masks.get(w)
        if m is not None:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def benchmark_items(benchmark: DataFrame, block: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).select("item_id", "text").distinct().collect()
    out = []
    for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text)):
        data, offsets = arrays.utf8(pa.array([r.text]))
        hashes, _ = words(data, offsets)
        pieces = -(-len(hashes) // MAX_ITEM_WORDS)
        out += [(r.item_id, p) for p in np.array_split(hashes, pieces)] if pieces else []
    return out


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least_lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """doc_id, item_id, lcs (share of the item's words) and answer (share of its answer words) of each confirmed match of
    an item in a window. Benchmark rows with a null text or without words are left out. The benchmark is searched for in
    blocks of bounded size, each over all documents."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    seen, n = passage_frequency(docs)
    idf = np.log((n + 1) / (seen + 1.0)) + 0.1  # above 0 for all cells: a passage that is copied often is still searched for
    blocks = max(1, -(-benchmark.count() // BLOCK_ITEMS))
    out = None
    for k in range(blocks):
        found = _search(spark, docs, Index(benchmark_items(benchmark, k, blocks), idf, least_lcs, answer), cosine, least_lcs, answer)
        out = found if out is None else out.unionByName(found)
    return out


def _search(spark: SparkSession, docs: DataFrame, index: Index, cosine: float, least_lcs: float, answer: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = [i for i, _ in index.items]
        lists = [w.tolist() for _, w in index.items]
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for a, _, data, offsets in arrays.text_slices(batch.column(1)):
                hashes, first = words(data, offsets)
                begin, first_passage = passages(first)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(first_passage))
                windows, items = index.candidates(hashes, begin, row, cosine)
                for w, i in zip(windows.tolist(), items.tolist(), strict=True):
                    size = len(lists[i])
                    text = hashes[max(first[row[w]], begin[w] - size) : min(first[row[w] + 1], begin[w] + 2 * STEP + size)].tolist()
                    share = lcs(lists[i], text) / size
                    if share >= least_lcs:
                        told = len(index.answers[i].intersection(text)) / len(index.answers[i])
                        if told >= answer:
                            out.append((doc_ids[a + row[w]], ids[i], share, told))
            best: dict[tuple, tuple] = {}
            for d, i, s, t in out:
                best[d, i] = max(best.get((d, i), (0, 0)), (s, t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in best], pa.int64()), pa.array([k[1] for k in best], pa.int64()), pa.array([v[0] for v in best.values()], pa.float64()), pa.array([v[1] for v in best.values()], pa.float64())], names=["doc_id", "item_id", "lcs", "answer"])

    return docs.mapInArrow(scan, "doc_id long, item_id long, lcs double, answer double")


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least_lcs: float = LCS, answer: float = ANSWER) -> DataFrame:
    """doc_id, n_items, item_id (of the best match, the least of equals) and lcs of every document that holds an item.

    Null and empty texts hold none. Rows that share an id, null ids too, are one document. Other columns are ignored;
    an empty benchmark or an empty table gives no row.
    """
    found = matches(docs, benchmark, cosine, least_lcs, answer).groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"))
    best = F.max(F.struct("lcs", (-F.col("item_id")).alias("i")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), best.alias("_b")).select("doc_id", "n_items", (-F.col("_b.i")).alias("item_id"), F.col("_b.lcs").alias("lcs"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")), "left_anti")
