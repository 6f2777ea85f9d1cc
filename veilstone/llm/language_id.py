"""Language identification by string kernels.

A text's features are the byte n-grams of length 1 to 3 that occur in it at all (a blended-spectrum presence kernel),
hashed into a fixed number of buckets; the kernel of two texts is the cosine of their presence vectors. A bounded,
stratified set of labelled texts gives Nystrom landmarks and the rows of a ridge regression, one against the rest for
each language. Scoring a batch is two matrix products: presence by landmarks, then by weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.llm import arrays

BUCKETS = 8192
SPECTRUM = 3
UNDETERMINED = "und"

#: ASCII other than letters counts as a blank, A-Z as a-z.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32
_FOLD[65:91] = _FOLD[97:123]
_STEPS = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text, of 0 and 1, scaled to length 1; zeros for a text without bytes."""
    n = len(offsets) - 1
    seen = np.zeros((n, BUCKETS), np.float32)
    if len(data):
        code = _FOLD[data]
        code[1:] = np.where((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E), code[1:] + 32, code[1:])
        row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
        flat = seen.ravel()
        gram = np.zeros(len(code), np.uint32)
        for k in range(SPECTRUM):
            gram = gram[: len(code) - k] + (code[k:] + np.uint32(1)) * _STEPS[k]
            own = row[: len(gram)] == row[k:] if k else slice(None)
            flat[row[: len(gram)][own] * BUCKETS + ((gram[own] ^ gram[own] >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(19))] = 1
    norms = np.sqrt(seen.sum(1))
    seen /= np.maximum(norms, 1)[:, None]
    return seen


class Model:
    """Landmarks and weights; score(texts) gives the regression's values by language."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows of values in [0, 1] that sum to 1."""
        out = np.empty((len(offsets) - 1, len(self.langs)), np.float32)
        for a in range(0, len(out), 512):
            at = offsets[a : a + 513]
            out[a : a + 512] = presence(data[at[0] : at[-1]], at - at[0]) @ self.landmarks.T @ self.weights
        sharp = np.exp(6 * (out - out.max(1, keepdims=True)))
        return sharp / sharp.sum(1, keepdims=True)


def least_hashes(hash_of: Column, count: Column | int, wanted: int) -> Column:
    """Whether a hash is among some 2 * `wanted` least ones of `count` rows: a test row by row that thins a sample out
    before it is ranked, so that no key's rows meet in one task."""
    share = F.least(F.lit(1.0), F.lit(2.0 * wanted + 100) / count)
    return hash_of.cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64)


def train(labelled: DataFrame, per_language: int = 400, landmarks: int = 256, ridge: float = 1e-3, most_languages: int = 256) -> Model:
    """Fit on rows (doc_id, text, lang) of the `most_languages` most frequent languages, at most `per_language` ids of each,
    those of least id hash.

    The executors read the sampled texts whole and send a bit for each bucket, so what is fitted in one place is
    bounded by these parameters. No text is shuffled; equal rows are learned once.
    """
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("_h"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_languages)
    some = labelled.join(F.broadcast(counts), "lang").filter(least_hashes(F.col("_h"), F.col("_n"), per_language))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    picked = some.select("doc_id", "lang", "_h").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).select("doc_id", "lang")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                bits = [np.packbits(presence(data[offsets[i] : offsets[i + 1]], offsets[i : i + 2] - offsets[i])[0] > 0).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    # per_language * most_languages ids at most
    rows = some.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang").mapInArrow(scan, "doc_id long, lang string, bits binary").distinct().toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("bits", "ascending")])
    label = rows.column("lang").to_pylist()
    langs = sorted(set(label))
    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, 0), np.float32))
    x = np.stack([np.unpackbits(np.frombuffer(v, np.uint8)) for v in rows.column("bits").to_pylist()]).astype(np.float32)
    x /= np.maximum(np.sqrt(x.sum(1)), 1)[:, None]
    target = np.array([[2.0 * (v == lang) - 1 for lang in langs] for v in label])
    of = [np.flatnonzero(target[:, k] > 0) for k in range(len(langs))]
    chosen = np.unique(np.concatenate([i[np.linspace(0, len(i) - 1, min(len(i), max(1, landmarks // len(langs)))).astype(int)] for i in of]))
    marks = x[chosen]
    k, kmm = (x @ marks.T).astype(np.float64), (marks @ marks.T).astype(np.float64)
    weight = np.array([len(label) / (len(langs) * len(of[langs.index(v)])) for v in label])
    left = k.T @ (k * weight[:, None]) + ridge * len(label) * kmm + 1e-6 * np.eye(len(chosen))
    return Model(langs, marks, np.linalg.solve(left, k.T @ (target * weight[:, None])).astype(np.float32))


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row, then the text if `keep_text`, then the columns in `keep`.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing was learned. Whole texts are
    read; one scan, no shuffle. Repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.landmarks, model.weights))  # bounded by train()'s parameters
    carried = (("text",) if keep_text else ()) + tuple(keep)
    fields = {f.name: f for f in docs.schema.fields}
    ddl = ", ".join(["doc_id long", "lang_pred string", "score double", *(f"`{c}` {fields[c].dataType.simpleString()}" for c in carried)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        names = pa.array([*own.langs, UNDETERMINED])
        for batch in batches:
            best = np.zeros(batch.num_rows, np.int64)
            score = np.zeros(batch.num_rows)
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                if own.langs:
                    values = own.score(data, offsets)
                    best[a:b], score[a:b] = values.argmax(1), values.max(1)
            lettered = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(own.langs)
            out = [batch.column(0), names.take(pa.array(np.where(lettered, best, len(own.langs)))), pa.array(np.where(lettered, np.clip(score, 0, 1), 0.0))]
            yield pa.RecordBatch.from_arrays(out + ([batch.column(1)] if keep_text else []) + batch.columns[3:], names=["doc_id", "lang_pred", "score", *carried])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", lettered.alias("_l"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(scan, ddl)


def fold(doc_id: Column, of: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo `of`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of
