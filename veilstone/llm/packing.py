"""Packing of token streams into fixed windows: concatenate and cut.

The first pass tokenizes each partition once, keeps the ids in a table and gives each document its offset within the
partition. The partitions' totals (one row a partition) become global offsets by a prefix sum. The second pass reads
the table and cuts each document at multiples of the window; a document over a boundary gives one record on each
side. No row is shuffled, and windows are full but for the very last one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

#: Words and ids that a Python worker remembers; with more of either it begins anew.
REMEMBERED, POOL = 600_000, 4_000_000
#: Bytes of text whose words are told apart at a time; a longer text is taken in parts that end behind a word.
PART_BYTES = 2 << 20
#: Words to a line where ids are told apart by word ends.
LINE_WORDS = 200
#: Signs behind a word that are a word of their own to the tokenizer. Not the apostrophe, which begins contractions, nor
#: those that special strings are made of.
SIGNS = ",.!?;:%*#&$@^~+=-_()[]{}/\\\"`"

_BREAK = np.zeros(256, bool)
_BREAK[[32, 10]] = True
_SIGN = np.isin(np.arange(256), list(SIGNS.encode()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Second bytes of the letters from U+00C0 to U+00FF, behind 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

_TOKENIZERS: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer for which white space separates words and is dropped.

    Texts are cut at ASCII blanks and line feeds only; each part is encoded whole by the library, so what the library
    does inside a part (other white space, special strings, normalisation) stays its own. A part of plain letters, with
    signs behind it or not, is the ids of its letters in lower case and of its signs. Each different part of a slice is
    looked up once; the ids of the slice are then gathered from a pool.
    """

    def __init__(self, path: str, end_id: int):
        import json

        from tokenizers import Tokenizer

        spec = json.load(open(path))  # noqa: SIM115
        if spec["truncation"] or spec["padding"] or "\\s" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("this tokenizer does not separate words by white space alone")
        if "Lowercase" not in json.dumps(spec["normalizer"]):
            raise ValueError("this tokenizer tells cases apart")
        self.tokenizer = Tokenizer.from_file(path)
        if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        suffix = spec["model"]["end_of_word_suffix"]
        self.is_end = np.zeros(1 << 16, bool)
        self.is_end[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        """Entry 0 is no ids, entry 1 the end of a document."""
        self.known: dict[str, int] = {"": 0}
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.filled, self.entries = np.zeros(1 << 20, "<u2"), 0, 1
        self.add(np.array([self.end_id], "<u2"), np.ones(1, np.int64))

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Put the ids of some words into the pool; the number of the first new entry."""
        first, n = self.entries, len(sizes)
        while first + n > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.begin[first : first + n] = self.filled + np.cumsum(sizes) - sizes
        self.size[first : first + n] = sizes
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.entries, self.filled = first + n, self.filled + len(ids)
        return first

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind it, and the offsets of texts in them."""
        ids, ends = [np.zeros(0, "<u2")], [np.zeros(1, np.int64)]
        for a, b in arrays.slices(offsets, PART_BYTES):
            at, parts = int(offsets[a]), []
            while offsets[b] - at > PART_BYTES:  # one long text
                breaks = np.flatnonzero(_BREAK[data[at + 1 : at + PART_BYTES]])
                if not breaks.size:
                    breaks = np.flatnonzero(_BREAK[data[at + PART_BYTES : offsets[b]]])[:1] + PART_BYTES - 1
                if not breaks.size:
                    break
                cut = at + 1 + int(breaks[-1])
                parts.append(self.part(data[at:cut], np.array([0, cut - at]), False)[0])
                at = cut
            rest = offsets[a : b + 1] - at
            rest[0] = 0
            got, end = self.part(data[at : offsets[b]], rest, True)
            if parts:
                got = np.concatenate([*parts, got])
                end = np.array([len(got)])
            ids.append(got)
            ends.append(end + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def part(self, data: np.ndarray, offsets: np.ndarray, close: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and where each text's end."""
        if self.entries > REMEMBERED or self.filled > POOL:
            self.reset()
        starts, ends, first = arrays.word_spans(data, offsets, ~_BREAK)
        bare = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))  # the last byte that is no sign
        bare = np.maximum(bare[ends - 1] + 1, starts) if len(ends) else ends
        after = np.append(data[1:], np.uint8(0))
        before = np.append(np.uint8(0), data[:-1])
        letter = _LETTER[data] | (data == 0xC3) & _LATIN[after] | (before == 0xC3) & _LATIN[data]
        others = np.concatenate(([0], np.cumsum(~letter, dtype=np.int64)))
        plain = others[bare] == others[starts]
        entry = np.zeros(2 * len(starts), np.int64)
        for where, text, x, y, encode in (
            (plain, _LOWER[data], starts, bare, self.encode_lines),
            (plain & (bare < ends), data, bare, ends, self.encode_each),
            (~plain, data, starts, ends, self.encode_each),
        ):
            own = np.flatnonzero(where)
            if own.size:
                entry[2 * own + (x is bare)] = self.look_up(text, x[own], y[own], encode)
        if close:
            entry = np.insert(entry, 2 * first[1:], 1)
        sizes = self.size[entry]
        total = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.begin[entry] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]
        return ids, total[2 * first[1:] + np.arange(len(first) - 1)] if close else total[-1:]

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> np.ndarray:
        """The entries of the words data[start:end]; new ones are encoded."""
        marks = np.zeros(len(data) + 1, np.int8)
        marks[starts] += 1
        marks[ends] -= 1
        held = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        inside = np.cumsum(marks[:-1], dtype=np.int8).view(bool)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(held), pa.py_buffer(data[inside])).dictionary_encode()
        unique = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, unique))
        new = [w for w, k in zip(unique, found, strict=True) if k is None]
        if new:
            first = self.add(*encode(new))
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            found = list(map(self.known.__getitem__, unique))
        return np.array(found, np.int64)[words.indices.to_numpy()]

    def encode_lines(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one word to the tokenizer each, many to a line; the ids that end a word tell them apart."""
        flat, sizes = [], []
        for a in range(0, len(words), 64 * LINE_WORDS):
            some = words[a : a + 64 * LINE_WORDS]
            lines = [" ".join(some[k : k + LINE_WORDS]) for k in range(0, len(some), LINE_WORDS)]
            ids = np.concatenate([np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            cuts = np.flatnonzero(self.is_end[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                raise AssertionError("ids do not fall apart into words")
            flat.append(ids)
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        sizes = []
        for a in range(0, len(words), 20_000):
            for e in self.tokenizer.encode_batch_fast(words[a : a + 20_000], add_special_tokens=False):
                ids = e.ids
                flat += ids
                sizes.append(len(ids))
        return np.array(flat, "<u2"), np.array(sizes, np.int64)


IDS = pa.schema([("part", pa.int64()), ("local", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECE_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, scope: str = "query", digest: bool = False) -> DataFrame:
    """Pieces of all documents, as laid out in windows of `window` ids.

    Returns doc_id, start (the document's ids in front of the piece), length, doc_tokens, sequence_id, offset (in the
    sequence, gapless from 0) and ids (little-endian unsigned 16-bit ids; with `digest` instead ids_crc32, of the ids
    as little-endian unsigned 32-bit). Each document is its ids and `end_id`, so a null or empty text is one id.
    Repeated rows are packed as often as they occur; other columns are ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (tokenizer_path, end_id) not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path, end_id] = WordEncoder(tokenizer_path, end_id)
        encode = _TOKENIZERS[tokenizer_path, end_id]
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                ids, ends = encode(data, offsets)
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(2 * ends), pa.py_buffer(ids)])
                yield arrays.columns(IDS, np.full(b - a, part), total + ends[:-1], batch.column(0).slice(a, b - a), held.cast(pa.binary()))
                total += int(ends[-1])

    table = store.keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenize, "part long, local long, doc_id long, ids binary"), scope)
    totals = table.groupBy("part").agg(F.sum(F.expr("octet_length(ids) div 2")).alias("n")).toArrow().sort_by("part")
    numbers, sums = (totals.column(n).to_numpy().astype(np.int64) for n in ("part", "n"))  # 16 bytes a partition
    shared = spark.sparkContext.broadcast((numbers, np.cumsum(sums) - sums))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, local, doc, ids = (batch.column(i) for i in range(4))
            sizes = np.diff(np.frombuffer(ids.cast(pa.large_binary()).buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]) // 2
            numbers, base = shared.value
            at = base[np.searchsorted(numbers, part.to_numpy())] + local.to_numpy()
            per = (at + sizes - 1) // window - at // window + 1
            row = np.repeat(np.arange(len(per)), per)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
            begin = np.maximum(at[row], (at[row] // window + nth) * window)
            end = np.minimum(at[row] + sizes[row], (at[row] // window + nth + 1) * window)
            start, length = begin - at[row], end - begin
            held = ids.to_pylist()
            pieces = [held[r][2 * s : 2 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            rest = (doc.take(pa.array(row)), start, length, sizes[row], begin // window, begin % window)
            if digest:
                yield arrays.columns(DIGESTS, *rest, [zlib.crc32(np.frombuffer(p, "<u2").astype("<u4").tobytes()) for p in pieces])
            else:
                yield arrays.columns(PIECES, *rest, pieces)

    return table.mapInArrow(cut, PIECE_DDL.replace("ids binary", "ids_crc32 long") if digest else PIECE_DDL)


DIGESTS = pa.schema([*list(PIECES)[:-1], ("ids_crc32", pa.int64())])
