"""Quality rules of documents and of the hosts that they come from.

Each document is measured in one scan. Failures of each rule are counted by host; a host's rate is shrunk towards the rate
of all hosts by a beta prior fitted to the hosts' own rates (method of moments), so a small host is not judged by a few
documents. The verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The FEATURES of each text of a slice."""
    starts, _, first = arrays.word_spans(data, offsets)
    hashes = arrays.unit_hashes(data, starts, arrays.WORD_VALUES)
    rows = np.arange(len(offsets) - 1)
    shingles, at = arrays.windows(hashes, first, WINDOW)
    row_of_word = np.repeat(rows, np.diff(first))
    twice = at[arrays.repeated(row_of_word[at], shingles)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    lines = arrays.line_starts(data, offsets)
    line_hash = arrays.unit_hashes(data, lines, arrays.LINE_VALUES)
    line_row = np.searchsorted(offsets, lines, "right") - 1
    words_in = np.diff(np.searchsorted(starts, np.append(lines, len(data)))) > 0
    keys = arrays.mix(line_hash[words_in] + arrays.mix(line_row[words_in].astype(np.uint64) + np.uint64(1)))
    _, kept = np.unique(keys, return_index=True)
    all_lines = np.bincount(line_row[words_in], minlength=len(rows))
    new_lines = np.bincount(line_row[words_in][kept], minlength=len(rows))
    return [
        np.diff(first),
        arrays.sums(arrays.IS_WORD[data] & arrays.IS_LEAD[data], offsets),
        arrays.sums(_IS_SYMBOL[data], offsets),
        all_lines - new_lines,
        arrays.sums(np.cumsum(cover[:-1]) > 0, first),
    ]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *((f, pa.int64()) for f in FEATURES)])


def features(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host and the FEATURES of every row; a null text counts as empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(2)):
                yield arrays.columns(_SCHEMA, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *measure(data, offsets))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), "text").mapInArrow(scan, "doc_id long, host string, " + ", ".join(f"{f} long" for f in FEATURES))


#: A rule's failure, by name; the host's verdict follows each rule on its own.
RULES = {
    "short": lambda p: F.col("n_words") < p["min_words"],
    "repeats": lambda p: 100 * F.col("n_repeat_words") > p["max_repeat_percent"] * F.col("n_words"),
    "symbols": lambda p: 100 * F.col("n_symbols") > p["max_symbol_percent"] * F.col("n_words"),
    "lines": lambda p: 100 * F.col("n_dup_lines") > p["max_line_percent"] * F.col("n_words"),
}
#: The rules that fail a document by themselves.
BASE = ("short", "repeats")


def beta_prior(hosts: DataFrame, fails: str) -> tuple[float, float]:
    """Alpha and beta of the failure rates of all hosts (n, `fails`), by moments weighted with the documents; (1, 1) where
    none can be fitted: no failure or nothing else, or no host of two documents, or one host alone."""
    f, n = F.col(fails), F.col("n")
    within = F.sum(f - f * f / n)
    m = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn"), within.alias("within")).first()
    if not m.k or m.k < 2 or m.n == m.k or not 0 < m.f < m.n:
        return 1.0, 1.0
    rate = m.f / m.n
    between, inside, size = (m.ff - m.f * rate) / (m.k - 1), m.within / (m.n - m.k), (m.n - m.nn / m.n) / (m.k - 1)
    alike = (between - inside) / max(between + (size - 1) * inside, 1e-12)  # the correlation of two documents of a host
    strength = min(max(1 / alike - 1, 1.0), 1000.0) if alike > 0 else 1000.0
    return rate * strength, (1 - rate) * strength


def judge(docs: DataFrame, host: Column | None = None, min_words: int = 20, max_repeat_percent: int = 30, max_symbol_percent: int = 100, max_line_percent: int = 20, max_host_rate: float = 0.5, scope: str = "query") -> DataFrame:
    """doc_id, host, FEATURES, base_failed, failed (names of all RULES that fail), host_rates (shrunk, by rule) and kept of
    every row.

    A document fails with under `min_words` words or over `max_repeat_percent` percent repeated words; symbols and repeated
    lines, against words, count for its host only. It is kept if it does not fail and no rule's failure rate of its host,
    shrunk towards that of all hosts, is over `max_host_rate`. A host of any size is judged; the prior alone keeps a small
    one from being judged by few documents. Null hosts are one host of their own. Null and empty texts have no words and
    fail; repeated rows are judged and counted each; other columns are ignored; an empty table gives no row.
    """
    host = F.col("source") if host is None else host
    limits = {"min_words": min_words, "max_repeat_percent": max_repeat_percent, "max_symbol_percent": max_symbol_percent, "max_line_percent": max_line_percent}
    table = store.keep(features(docs, host).select("*", *(rule(limits).alias(f"_{name}") for name, rule in RULES.items())), scope)
    hosts = table.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"_{name}").cast("long")).alias(name) for name in RULES))
    hosts = store.keep(hosts, scope)
    rates = []
    for name in RULES:
        alpha, beta = beta_prior(hosts, name)
        rates.append(((F.col(name) + alpha) / (F.col("n") + (alpha + beta))).alias(name))
    verdicts = hosts.select(F.col("host").alias("_host"), F.struct(*rates).alias("host_rates"))
    bad = F.greatest(*(F.col(f"host_rates.{name}") for name in RULES)) > max_host_rate
    failed = F.filter(F.array(*(F.when(F.col(f"_{name}"), F.lit(name)) for name in RULES)), lambda x: x.isNotNull())
    base = F.col(f"_{BASE[0]}") | F.col(f"_{BASE[1]}")
    return table.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").select("doc_id", "host", *FEATURES, base.alias("base_failed"), failed.alias("failed"), "host_rates", (~base & ~bad).alias("kept"))
