"""Removal of repeated runs of lines, by winnowing over line hashes.

The lines of a text that hold a word are hashed. A gram is the shortest run of lines from a line on that has GRAM_WORDS
words; of each window, the shortest run that has `window_words` words, the gram of least hash is an anchor. Any run of
that many words that occurs twice holds a whole window in both places, so the same anchor is chosen in both: this is a
guarantee. Equal anchors are matched with all earlier occurrences at once, as follows, and the later runs go.

An anchor's context goes back to the line behind the anchor before it and on to the end of the next anchor's gram. A match
need not look further: where a run goes on beyond these, it holds that anchor's gram, which is matched as well. The keys of
an anchor are the hashes of its gram, of its gram with the 1, 2, ... lines in front, and of its gram with the 1, 2, ...
lines behind, as far as the context goes. A run of lines is a repeat if its key occurs at an earlier place, so the
longest match with any earlier occurrence is found without listing pairs. Keys that meet in one slice of texts are matched
there, and only the first place of each is shuffled. The least place of a key is a partial aggregate, joined back by a
merge that splits hot keys, so a passage that very many documents share never gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

GRAM_WORDS = 25
WINDOW_WORDS = 50
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)
#: Stands for a null id inside; larger than any other.
NO_ID = 2**63 - 1


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of the leftmost least value of each values[first:last + 1], by a table of doubling spans."""
    place = np.arange(len(values))
    level, tables = 1, [place]
    while level <= (last - first).max(initial=0):
        a = tables[-1]
        b = a[np.minimum(place + level, len(values) - 1)]
        tables.append(np.where(values[b] < values[a], b, a))
        level *= 2
    k = np.frexp(last - first + 1)[1] - 1
    table = np.stack(tables)
    a, b = table[k, first], table[k, last - (1 << k) + 1]
    return np.where(values[b] < values[a], b, a)


def run_hashes(prefix: np.ndarray, back: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of lines begin..end - 1, wherever they are."""
    return arrays.mix((prefix[end] - prefix[begin]) * back[begin])


def anchors(data: np.ndarray, offsets: np.ndarray, gram_words: int, window_words: int) -> dict[str, np.ndarray]:
    """The anchors of a slice: row, at and end (numbers of the gram's first line in the slice and of the line behind it),
    and the span lo..hi of lines that is each one's context; with the number of each row's first line in the slice, and
    sums and powers for run_hashes()."""
    starts = arrays.line_starts(data, offsets)
    words, _, _ = arrays.word_spans(data, offsets)
    n_words = np.diff(np.searchsorted(words, np.append(starts, len(data))))
    hashes = arrays.unit_hashes(data, starts, arrays.LINE_VALUES)
    wordy = n_words > 0
    starts, n_words, hashes = starts[wordy], n_words[wordy], hashes[wordy]
    row = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)))
    empty = np.zeros(0, np.int64)
    out = {"first": first, "row": empty, "at": empty, "end": empty, "lo": empty, "hi": empty}
    if not len(starts):
        return out
    total = np.concatenate(([0], np.cumsum(n_words)))
    end_of_row = first[row + 1]
    reach = lambda least: np.searchsorted(total, total[:-1] + least, "left")  # noqa: E731  one past the last line
    gram_end, window_end = reach(gram_words), reach(window_words)
    line = np.arange(len(starts))
    power, back = np.full(len(line) + 1, _BASE, np.uint64), np.full(len(line) + 1, _INVERSE, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)))
    stop = np.minimum(gram_end, len(line))
    grams = run_hashes(prefix, back, line, stop)
    windows = np.flatnonzero(window_end <= end_of_row)
    if not windows.size:
        return out
    # Grams whose last line lies within the window: their first lines are a prefix of the window's lines.
    last = np.searchsorted(gram_end, window_end[windows], "right") - 1
    chosen = np.unique(_least(grams, windows, last))
    same = np.diff(row[chosen]) == 0
    lo, hi = first[row[chosen]], end_of_row[chosen]
    lo[1:] = np.where(same, chosen[:-1] + 1, lo[1:])
    hi[:-1] = np.where(same, gram_end[chosen[1:]], hi[:-1])
    return out | {"row": row[chosen], "at": chosen, "end": gram_end[chosen], "lo": lo, "hi": hi, "prefix": prefix, "back": back}


_SCHEMA = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("to", pa.int32())])
_DDL = "key long, doc long, th long, at int, from int, to int"


def context_runs(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the anchor, first line and line behind the last, of the gram of each anchor with the lines of its context
    added one by one in front, and one by one behind."""
    nth = lambda count: np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    number = np.arange(len(x["at"]))
    n_back, n_ahead = x["at"] - x["lo"] + 1, x["hi"] - x["end"]  # back: the gram alone, too
    b, a = np.repeat(number, n_back), np.repeat(number, n_ahead)
    begin = np.concatenate((x["at"][b] - nth(n_back), x["at"][a]))
    end = np.concatenate((x["end"][b], x["end"][a] + nth(n_ahead) + 1))
    return np.concatenate((b, a)), begin, end


def repeated_runs(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, scope: str = "query") -> DataFrame:
    """doc, th (xxhash64 of the text) and runs (array of from, to: the word-holding lines from..to - 1, counted within
    the text) that occurred before, in a text of lesser (id, th) or further up in the same text. A run is the gram of an
    anchor with all that some earlier occurrence has in front of it too, and all that one, maybe another, has behind."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in arrays.text_slices(batch.column(2)):
                x = anchors(data, offsets, gram_words, window_words)
                if not len(x["at"]):
                    continue
                own, begin, end = context_runs(x)
                key = run_hashes(x["prefix"], x["back"], begin, end)
                row = x["row"][own]
                base = x["first"][row]
                doc, th, at, start, stop = docs_[a:b][row], ths[a:b][row], x["at"][own] - base, begin - base, end - base
                order = np.lexsort((start, th, doc, key))
                head = np.ones(len(order), bool)
                head[1:] = key[order[1:]] != key[order[:-1]]
                first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                # Repeated rows are one text: a run at the first one's own place is no later one.
                twin = (doc[order] == doc[first]) & (th[order] == th[first]) & (start[order] == start[first])
                later, keep = order[~twin], order[head]
                if len(later):
                    least, most = np.full(len(x["at"]), len(data)), np.zeros(len(x["at"]), np.int64)
                    np.minimum.at(least, own[later], start[later])
                    np.maximum.at(most, own[later], stop[later])
                    cut, one = np.unique(own[later], return_index=True)
                    one = later[one]
                    yield arrays.columns(_SCHEMA, pa.array([None] * len(cut), pa.int64()), doc[one], th[one], at[one], least[cut], most[cut])
                yield arrays.columns(_SCHEMA, key[keep].view(np.int64), doc[keep], th[keep], at[keep], start[keep], stop[keep])

    rows = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), "text")
    table = store.keep(rows.mapInArrow(scan, _DDL), scope)
    place = F.struct("doc", "th", "from")
    run = ["doc", "th", "at", "from", "to"]
    heads = table.filter(F.col("key").isNotNull())
    # The first place of each key that has several: by partial sums, then a join that splits a hot key.
    first = store.keep(heads.groupBy("key").agg(F.min(place).alias("f"), F.count("*").alias("n")).filter("n > 1").select("key", "f"), scope)
    across = heads.join(first.hint("merge"), "key").filter(F.col("f") != place).select(*run)
    found = across.union(table.filter(F.col("key").isNull()).select(*run)).groupBy("doc", "th", "at").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    runs = store.keep(found.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("runs")), scope)  # of one text: one an anchor
    for done in (table, first):
        store.discard(done)
    return runs


def cut(df: DataFrame, text: Column, runs: Column) -> DataFrame:
    """Adds `_kept` and `_n`: the lines of a text without the word-holding lines of `runs`, blank lines inside a run included,
    and how many lines that removes; both null where `runs` is. Overlapping runs, which ascend, are made one first."""

    def join(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        both = F.struct(last["from"].alias("from"), F.greatest(last["to"], r["to"]).alias("to"))
        return F.when(F.size(done) == 0, F.array(r)).when(r["from"] < last["to"], F.array_append(F.slice(done, 1, F.size(done) - 1), both)).otherwise(F.array_append(done, r))

    merged = F.aggregate(runs, F.array().cast("array<struct<from:int,to:int>>"), join)
    split = df.withColumns({"_lines": F.when(runs.isNotNull(), F.split(text, "\n", -1)), "_merged": merged})
    wordy = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get("_lines", i).rlike(r"[^\x20\x09-\x0D]"))
    placed = split.withColumn("_wordy", F.when(F.col("_lines").isNotNull(), wordy))
    places = F.transform("_merged", lambda r: F.struct(F.get("_wordy", r["from"]).alias("a"), F.get("_wordy", r["to"] - 1).alias("b")))
    # A generator's output is evaluated once: else the places are written into the filter, and told anew for every line.
    placed = placed.select(*df.columns, "_lines", F.explode_outer(F.array(F.struct(places.alias("p")))).alias("_places"))
    kept = F.filter("_lines", lambda line, i: ~F.exists(F.col("_places.p"), lambda p: (p["a"] <= i) & (i <= p["b"])))
    return placed.withColumn("_kept", kept).withColumn("_n", F.size("_lines") - F.size("_kept")).drop("_lines", "_places")


def dedup(docs: DataFrame, gram_words: int = GRAM_WORDS, window_words: int = WINDOW_WORDS, scope: str = "query") -> DataFrame:
    """The rows of `docs`, all columns, with text cut, and n_removed (lines) and runs added.

    Every run of whole lines with `window_words` words or more that occurs again, in any text, is found; of runs found,
    those of `gram_words` words or more go from all places but the first. Order is by doc_id, then by the text's hash;
    null ids come last. Lines without a word neither match nor stop a match. Rows equal in id and text are one text.
    A null text stays null, with n_removed 0; other columns are carried along whatever their names.
    """
    runs = repeated_runs(docs, gram_words, window_words, scope)
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"))
    joined = held.join(runs.hint("merge"), ["doc", "th"], "left")  # runs grow with the input: no broadcast at any size

    done = cut(joined, F.col("_row.text"), F.col("runs"))
    new = F.coalesce(F.array_join("_kept", "\n"), F.col("_row.text"))
    told = F.struct(new.alias("text"), F.when(F.col("_kept").isNotNull(), F.col("_n")).otherwise(0).cast("int").alias("n"))
    # As a generator's output it is evaluated once: else a filter on it is pushed below, with all of it written out again.
    done = done.select("_row", "runs", F.explode_outer(F.array(told)).alias("_cut"))
    return done.select(F.col("_row").withField("text", F.col("_cut.text")).alias("_row"), F.col("_cut.n").alias("n_removed"), F.coalesce("runs", F.array().cast("array<struct<from:int,to:int>>")).alias("runs"))
