"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: density of a learned lexicon (plain, and only after undoing digits and signs put for letters), how many of
its words stand near a second person, capitals, punctuation, exclamation, obfuscation, lengths. The lexicon is learned
from word counts, the trees and the calibration from dense rows, of a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store
from veilstone.llm.language_id import least_hashes

#: Second persons of the learned languages, and the reach in words.
SECOND_PERSON = ("you", "your", "yours", "youre", "u", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "su")
REACH = 6
#: Signs that are put for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NAMES = ("lexicon", "lexicon_hits", "hidden_lexicon", "lexicon_weight", "near_person", "person", "capitals", "punctuation", "exclamation", "symbols", "digits", "obfuscated", "words", "word_length")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>@^~_+="))
_PUNCT = np.isin(np.arange(256), list(b".,;:!?'\"()-"))


def _values(plain: bool) -> np.ndarray:
    """Byte values under which a word's case, and signs at its end, do not count."""
    v = arrays.byte_values(13, fold_case=True)
    v[~_LETTER & ~_DIGIT] = 0
    if not plain:
        for sign, letter in STANDS_FOR.items():
            v[ord(sign)] = v[ord(letter)]
    return v


_PLAIN, _UNDONE = _values(True), _values(False)


def hash_words(words) -> np.ndarray:
    data, offsets = arrays.utf8(pa.array(list(words)))
    return arrays.unit_hashes(data, offsets[:-1], _PLAIN)


_PERSONS = np.sort(hash_words(SECOND_PERSON))


def _within(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of words behind leading signs, so that these do not shift the letters."""
    starts = starts.copy()
    for _ in range(4):
        ahead = (starts < ends - 1) & ~(_LETTER | _DIGIT)[data[np.minimum(starts, len(data) - 1)]]
        if not ahead.any():
            break
        starts[ahead] += 1
    return starts


def word_keys(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = arrays.word_spans(data, offsets)
    begin = _trimmed(data, starts, ends)
    return starts, ends, first, arrays.unit_hashes(data, begin, _PLAIN), arrays.unit_hashes(data, begin, _UNDONE)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; zeros for one without words."""
    starts, ends, first, plain, undone = word_keys(data, offsets)
    at, hit = _within(lexicon, plain)
    _, found = _within(lexicon, undone)
    hidden = found & ~hit
    _, person = _within(_PERSONS, plain)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    near = np.zeros(len(plain), bool)
    for step in range(1, REACH + 1):
        if len(plain) > step:
            same = row[step:] == row[:-step]
            near[step:] |= person[:-step] & same
            near[:-step] |= person[step:] & same
    run = lambda mask: np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
    signs, digits, letters = run(_SYMBOL | _PUNCT), run(_DIGIT), run(_LETTER)
    inside = np.maximum(ends - 1, starts)
    mixed = (letters[ends] - letters[starts] > 0) & ((digits[ends] - digits[starts]) + (signs[inside] - signs[np.minimum(starts + 1, inside)]) > 0)
    n, size = np.maximum(np.diff(first), 1), np.maximum(np.diff(offsets), 1)
    total = lambda x: arrays.sums(x, first)
    chars = lambda mask: arrays.sums(mask[data], offsets) / size
    heavy = np.concatenate(([0.0], np.cumsum(np.where(hit, weights[at] if len(weights) else 0.0, 0.0))))
    out = [total(hit) / n, total(hit), total(hidden) / n, (heavy[first[1:]] - heavy[first[:-1]]) / n, total(hit & near) / n, total(person) / n, chars(_UPPER), chars(_PUNCT), chars(data_mask("!")), chars(_SYMBOL), chars(_DIGIT), total(mixed) / n, np.log1p(np.diff(first)), size / n]
    return np.stack(out, 1) * (np.diff(first) > 0)[:, None]


def data_mask(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), list(chars.encode()))


class Trees:
    """Logistic gradient boosting with depth-limited trees over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        nodes = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            node = np.zeros(len(y), np.int64)
            for k in range(nodes):
                own = np.flatnonzero(node == k)
                if not own.size:
                    continue
                gs, hs = g[own].sum(), h[own].sum()
                value[k] = self.rate * gs / (hs + 1.0)
                if k >= nodes // 2 or len(own) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    size = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(codes[own, f], g[own], size))[:-1]
                    hl = np.cumsum(np.bincount(codes[own, f], h[own], size))[:-1]
                    nl = np.cumsum(np.bincount(codes[own, f], minlength=size))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.least) | (len(own) - nl < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
                if best[1] >= 0:
                    feature[k], cut[k] = best[1], edges[best[1]][best[2]]
                    node[own] = 2 * k + 1 + (codes[own, best[1]] > best[2])
            self.trees.append((feature, cut, value))
            score += value[node]
        return self

    def decide(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            score += value[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v2, blocks[-1][1] + n2, blocks[-1][2], hi]
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    return at, np.array([x for b in blocks for x in (b[0] / b[1],) * 2])


class Model:
    def __init__(self, lexicon, weights, trees, knots, base):
        self.lexicon, self.weights, self.trees, self.knots, self.base = lexicon, weights, trees, knots, base

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.base)
        raw = self.trees.decide(features(data, offsets, self.lexicon, self.weights))
        fitted = np.interp(raw, *self.knots)
        # Isotonic steps tie; a small share of the raw order keeps the ranking within a step.
        return np.clip(0.999 * fitted + 0.001 / (1 + np.exp(-raw)), 0, 1)


_PAIRS = pa.schema([("word", pa.int64()), ("part", pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])
#: Parts that the calibration is crossed over: each is scored by a model that has seen neither its rows nor its words.
PARTS = 8


def learn_lexicons(rows: DataFrame, size: int = 400, support: int = 5, scope: str = "query") -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and log odds of the words most typical of toxic rows (text, toxic, part): without each part in turn, then over all
    rows given, in train() the sampled labelled ones. Counts are of documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for a, b, data, offsets in arrays.text_slices(batch.column(0)):
                _, _, first, plain, _ = word_keys(data, offsets)
                row = np.repeat(np.arange(b - a), np.diff(first))
                _, kept = np.unique(arrays.mix(plain + arrays.mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)
                words, inverse = np.unique(plain[kept], return_inverse=True)
                cell, inverse = np.unique(inverse * PARTS + part[a:b][row[kept]], return_inverse=True)
                toxic = np.bincount(inverse, label[a:b][row[kept]] == 1, len(cell)).astype(np.int64)
                yield arrays.columns(_PAIRS, words.view(np.int64)[cell // PARTS], cell % PARTS, toxic, np.bincount(inverse, minlength=len(cell)) - toxic)

    counted = rows.select("text", F.col("toxic").cast("int"), "part").mapInArrow(scan, "word long, part int, toxic long, clean long")
    names = [f"{kind}{k}" for kind in ("toxic", "clean") for k in range(PARTS)]
    by_part = [F.sum(F.when(F.col("part") == int(n[5:]), F.col(n[:5])).otherwise(0)).alias(n) for n in names]
    held = store.keep(counted.groupBy("word").agg(*by_part).filter(sum((F.col(f"toxic{k}") for k in range(PARTS)), F.lit(0)) >= support), scope)
    sizes = {r.part: (r.t, r.n - r.t) for r in rows.groupBy("part").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("t"), F.count("*").alias("n")).collect()}
    out = []
    for left in (*range(PARTS), None):
        used = [k for k in range(PARTS) if k != left]
        t, c = (sum(sizes.get(k, (0, 0))[j] for k in used) for j in (0, 1))
        toxic, clean = (sum((F.col(f"{kind}{k}") for k in used), F.lit(0)) for kind in ("toxic", "clean"))
        odds = F.log((toxic + 0.5) / (t + 1.0)) - F.log((clean + 0.5) / (c + 1.0))
        best = held.select("word", toxic.alias("n"), odds.alias("odds")).filter((F.col("n") >= support) & (F.col("odds") > 1.5)).orderBy(F.desc(F.col("odds") * F.sqrt("n")), "word").limit(size).collect()
        words = np.array([r.word for r in best], np.int64).view(np.uint64)
        order = np.argsort(words)
        out.append((words[order], np.array([r.odds for r in best])[order]))
    store.discard(held)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, scope: str = "query") -> Model:
    """Fit on docs (doc_id, text) that have labels (doc_id, toxic), at most `sample` rows of labels, those of least id hash:
    lexicon and trees on all of these, whole texts. The calibration is crossed: each eighth of the rows, told by a hash of
    the id, is scored by a lexicon and trees of the other seven.

    Rows without a label are not learned from; repeated rows count once. The sampled labels are broadcast to the texts.
    """
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("_h"))
    some = labels.filter(least_hashes(F.col("_h"), F.lit(max(labels.count(), 1)), sample)).distinct()
    picked = some.orderBy("_h", "doc_id", "toxic").limit(sample).select("doc_id", "toxic")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    rows = store.keep(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").distinct().withColumn("part", part), scope)
    lexicons = learn_lexicons(rows, scope=scope)
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)  # PARTS + 1 times `size` words at most
    names = [f"f{i}" for i in range(len(NAMES) * (PARTS + 1))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                x = np.hstack([features(data, offsets, *one) for one in shared.value])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 2, 3)), *(pa.array(c) for c in x.T)], names=["doc_id", "toxic", "part", *names])

    table = rows.select("doc_id", "text", "toxic", "part").mapInArrow(scan, "doc_id long, toxic int, part int, " + ", ".join(f"{n} double" for n in names)).toPandas().sort_values(["doc_id", *names])
    store.discard(rows)
    y = (table["toxic"].to_numpy() == 1).astype(float)
    base = float(y.mean()) if len(y) else 0.0
    if len(y) < 20 or base in (0.0, 1.0):
        return Model(*lexicons[-1], None, None, base)
    x, eighth = np.split(table[names].to_numpy(), PARTS + 1, axis=1), table["part"].to_numpy()
    trees = Trees().fit(x[-1], y)
    crossed = trees.decide(x[-1])  # stays where the other parts hold no rows of both kinds
    for k in range(PARTS):
        own = eighth == k
        if len(set(y[~own])) == 2:
            crossed[own] = Trees().fit(x[k][~own], y[~own]).decide(x[k][own])
    return Model(*lexicons[-1], trees, isotonic(crossed, y), base)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if the score reaches `threshold`) of every row.

    Null and empty texts have zero features and the score of those. Whole texts are read; one scan, no shuffle.
    Repeated rows give a row each; other columns are ignored; without labels of both kinds the score is their rate.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train()'s parameters

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                yield arrays.columns(_SCHEMA, batch.column(0).slice(a, b - a), shared.value.score(data, offsets))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
