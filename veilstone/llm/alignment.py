"""Alignment of two tokenizers' tokens over a corpus, by id-striped dense count matrices.

Both tokenizers encode a blank and the text. Where tokens of both end at one byte, a group ends and its last two tokens
are linked. A text is cut into units at blanks and line feeds that no token of either side reaches over; a Python
worker encodes each different unit once, so a document is a list of units.

The first pass keeps a table of blocks: documents as units, units as links, and the block's different id pairs with
their counts. Pairs are dealt by the stripe of their B id (id modulo STRIPES), so what a frequent id sends is its
different pairs a block, not its links. A stripe's counts are added into a dense matrix of its B ids by all A ids
(np.add.at); a row's maximum is the best count of its B id. Then the stripe's cells and the blocks' pairs meet by stripe:
the matrix is filled again, and each block gets the counts of its pairs. At last a block's scores meet its documents.
Every fold reads sorted rows one by one; memory is one matrix or one block, whatever their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store

#: Stripes of B ids; a matrix has (B ids / STRIPES, upwards) x A ids cells of 8 bytes, here 25 MB.
STRIPES = 512
#: Units from which a block is complete, counted behind each slice of texts; and cells of a matrix to a row.
BLOCK_UNITS, CELLS = 1 << 18, 1 << 17
#: Different units, and bytes of them, that a Python worker remembers between blocks.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20

#: Bytes that are no white space to either tokenizer, beside a cut: printable ASCII, and letters behind 0xC3.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True


def byte_level() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, others by rank from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers, their tokens' bytes, and the units that were encoded so far."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.load(open(a_path))  # noqa: SIM115
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("side A has to be a plain byte-level tokenizer")
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of, plain = byte_level(), {t["id"]: t["content"] for t in spec["added_tokens"]}
        a_bytes = [plain[i].encode() if i in plain else bytes(map(byte_of.__getitem__, self.a.id_to_token(i) or "")) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("side B has to begin pieces at blanks and spell line feeds as bytes")
        self.blank = self.b.piece_to_id("▁")
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spelled_a, self.spelled_b = Pool(a_bytes), Pool(b_bytes)
        self.size_a, self.size_b = len(a_bytes), len(b_bytes)
        # an id in writing, twice for each side: inside a group, and at its side's end of one
        self.written = Pool([f"{i}{end}".encode() for ends in (",|", ",;") for i in range(max(self.size_a, self.size_b)) for end in ends])
        self.reset()

    def reset(self) -> None:
        """Entry 0 is a unit that one of the sides spells otherwise."""
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = [b""]
        self.n_a, self.n_b, self.n_links = ([np.zeros(1, np.int64)] for _ in range(3))
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def full(self) -> bool:
        return len(self.groups) > REMEMBERED or self.held > REMEMBERED_BYTES

    def told(self, name: str) -> np.ndarray:
        """All of n_a, n_b, n_links (by entry) or pairs, as one array."""
        parts = getattr(self, name)
        if len(parts) > 1:
            parts[:] = [np.concatenate(parts)]
        return parts[0] if parts else np.zeros(0, np.int64)

    def entries(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The entries of the units between the cuts."""
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        unique = units.dictionary.to_pylist()
        found = list(map(self.known.get, unique))
        new = [u for u, k in zip(unique, found, strict=True) if k is None]
        for a in range(0, len(new), 5000):
            self.learn(new[a : a + 5000])
        if new:
            found = list(map(self.known.__getitem__, unique))
        return np.array(found, np.int64)[units.indices.to_numpy()]

    def learn(self, units: list[str]) -> None:
        left = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        right = self.b.encode([u.removeprefix(" ") for u in units], num_threads=1)
        # side B puts a blank in front; a line feed stands alone behind it
        right = [ids[1:] if u[0] != " " and ids[:1] == [self.blank] else ids for u, ids in zip(units, right, strict=True)]
        spelled = [u.encode() for u in units]
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (left, right))
        whole = np.frombuffer(b"".join(spelled), np.uint8)
        if not np.array_equal(self.spelled_a.joined(a), whole) or not np.array_equal(self.spelled_b.joined(b), whole):
            same = lambda pool, ids, text: pool.joined(np.array(ids, np.int64)).tobytes() == text
            good = [k for k, text in enumerate(spelled) if same(self.spelled_a, left[k], text) and same(self.spelled_b, right[k], text)]
            self.known.update(dict.fromkeys(units, 0))
            units, left, right = ([x[k] for k in good] for x in (units, left, right))
            a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (left, right))
        if units:
            self.align(units, a, b, np.array(list(map(len, left)), np.int64), np.array(list(map(len, right)), np.int64))

    def align(self, units: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        """New entries of units that both sides spell alike: where tokens of both end at one byte, a group ends. Units end so
        too, therefore all units are aligned at once."""
        end_a, end_b = np.cumsum(self.spelled_a.sizes[a]), np.cumsum(self.spelled_b.sizes[b])
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        pairs = b[last_b] * self.size_a + a[last_a]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = (np.concatenate(([0], np.flatnonzero(x) + 1)) for x in (last_a, last_b))  # tokens in the groups before
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + upto_b[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + upto_a[group_b + 1]] = 2 * (max(self.size_a, self.size_b) + b) + last_b
        text = self.written.joined(order).tobytes()
        ends = np.cumsum(self.written.sizes[order])[np.cumsum(n_a + n_b) - 1].tolist()
        first = len(self.groups)
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.groups += [text[x : y - 1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.n_links.append(arrays.sums(last_a, np.concatenate(([0], np.cumsum(n_a)))))
        self.pairs.append(pairs)
        self.held += len(text) + 8 * len(pairs)


class Pool:
    """Byte strings side by side, to be joined by number."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.array(list(map(len, values)), np.int64)
        self.begin, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(values), np.uint8)

    def joined(self, which: np.ndarray) -> np.ndarray:
        return self.data[_expand(self.begin[which], self.sizes[which])]


def blanked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank put in front of each text that is not empty."""
    sizes = np.diff(offsets)
    ends = np.concatenate(([0], np.cumsum(sizes + (sizes > 0))))
    out = np.full(ends[-1], 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(ends[1:] - offsets[1:], sizes)] = data
    return out, ends


def unit_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units, the data's end behind them, and the number of each text's first unit."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lead = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = lead[:-1]
    before, after = _PLAIN[data] | tail, _PLAIN[data] | lead
    cut = np.zeros(len(data), bool)
    cut[1:-1] = _CUT[data[1:-1]] & before[:-2] & after[2:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(cut)
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


@lru_cache(1)
def sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


def _written(docs: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, Sides]]:
    """doc_id, entries, and each document's first entry, by slice. What a worker remembers goes only between slices, when
    the reader asks for it."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    known = sides(a_path, b_path)
    for batch in docs:
        for a, b, data, offsets in arrays.text_slices(batch.column(1)):
            data, offsets = blanked(data, offsets)
            cuts, first = unit_cuts(data, offsets)
            yield batch.column(0).slice(a, b - a), known.entries(data, cuts), first, known


_BLOCK_DDL = "block long, size int, doc_id array<long>, n_a array<long>, n_b array<long>, n_links array<long>, sha array<string>, doc_units binary, units binary, unit_links binary, links binary, pairs binary, counts binary"
_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int32()), *((n, pa.list_(pa.int64())) for n in ("doc_id", "n_a", "n_b", "n_links")), ("sha", pa.list_(pa.string())), *((n, pa.binary()) for n in ("doc_units", "units", "unit_links", "links", "pairs", "counts"))])
_SIDE_DDL = "stripe int, kind int, block long, at binary, pairs binary, counts binary, best binary"
_SIDE = pa.schema([("stripe", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def _packed(x: np.ndarray) -> bytes:
    """An array for storing: bytes of one rank side by side, compressed. Frequent things have small numbers, so most are 0."""
    data = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _expand(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin[k], begin[k] + 1, ..., sizes[k] of them, one k behind the other."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents as units, units as links, different pairs with counts: a row for each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = TaskContext.get().partitionId() << 32, []
        held, known = 0, None

        def block() -> pa.RecordBatch:
            entry, unit, often = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            entry, often, unit = entry[order], often[order], place[unit]
            sizes, upto = known.told("n_links")[entry], np.cumsum(known.told("n_links"))
            links = known.told("pairs")[_expand(upto[entry] - sizes, sizes)]
            pairs, link = np.unique(links, return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, link, np.repeat(often, sizes))
            starts = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
            flat = [np.concatenate([p[k] for p in parts]).tolist() for k in (3, 4, 5)]
            ids = [i for p in parts for i in p[0].to_pylist()]
            own = (starts, unit, np.concatenate(([0], np.cumsum(sizes))), link.astype(np.int32), pairs, counts)
            return _rows(_BLOCK, [(number, len(pairs), ids, *flat, [s for p in parts for s in p[6]], *map(_packed, own))])

        for ids, entries, first, known in _written(batches, a_path, b_path):
            broken = arrays.sums(entries == 0, first) > 0
            if broken.any():  # such a document has no units at all
                entries = entries[~np.repeat(broken, np.diff(first))]
                first = np.concatenate(([0], np.cumsum(np.where(broken, 0, np.diff(first)))))
            n_a, n_b, n_links = (known.told(n)[entries] for n in ("n_a", "n_b", "n_links"))
            order, texts = entries.tolist(), known.groups
            sha = ["" if x == y else hashlib.sha256(b";".join([texts[e] for e in order[x:y]])).hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            parts.append((ids, entries, first, *(arrays.sums(n, first) for n in (n_a, n_b, n_links)), sha))
            held += len(entries)
            if held >= BLOCK_UNITS or known.full():
                yield block()
                parts, held, number = [], 0, number + 1
                if known.full():
                    known.reset()
        if parts:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, _BLOCK_DDL)


def _vocabulary(a_path: str, b_path: str) -> tuple[int, int]:
    known = sides(a_path, b_path)
    return known.size_a, known.size_b


def _requests(table: DataFrame, size_a: int) -> DataFrame:
    """Each block's different pairs by stripe of the B id."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, counts = _unpacked(pairs, np.int64), _unpacked(counts, np.int64)
                stripe = pairs // size_a % STRIPES
                order = np.argsort(stripe, kind="stable").astype(np.int32)
                held, first = np.unique(stripe[order], return_index=True)
                ends = np.append(first[1:], len(order))
                if len(held):
                    yield _rows(_SIDE, [(s, 1, block, (o := order[x:y]).tobytes(), pairs[o].tobytes(), counts[o].tobytes(), None) for s, x, y in zip(held.tolist(), first.tolist(), ends.tolist(), strict=True)])

    return table.select("block", "pairs", "counts").mapInArrow(split, _SIDE_DDL)


def _by_stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(len(batch)):
            row = [c[k].as_py() for c in batch.columns]
            yield *row[:3], *(None if v is None else np.frombuffer(v, t) for v, t in zip(row[3:], (np.int32, np.int64, np.int64, bool), strict=True))


def _cells(requests: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """The cells above 0 of each stripe's matrix, and whether a cell is its row's maximum."""
    rows = -(-size_b // STRIPES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(rows * size_a, np.int64), None

        def cells() -> Iterator[pa.RecordBatch]:
            some = np.flatnonzero(matrix)
            best = matrix.reshape(rows, size_a).max(1)
            for a in range(0, len(some), CELLS):
                at = some[a : a + CELLS]
                row, left = at // size_a, at % size_a
                yield _rows(_SIDE, [(now, 0, None, None, ((row * STRIPES + now) * size_a + left).tobytes(), matrix[at].tobytes(), (matrix[at] == best[row]).tobytes())])
            matrix[some] = 0

        for stripe, _, _, _, pairs, counts, _ in _by_stripe(batches):
            if stripe != now:
                if now is not None:
                    yield from cells()
                now = stripe
            np.add.at(matrix, pairs // size_a // STRIPES * size_a + pairs % size_a, counts)
        if now is not None:
            yield from cells()

    return requests.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add, _SIDE_DDL)


def _scores(cells: DataFrame, requests: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """Counts of each block's pairs over the corpus, and whether they are the best of their B id."""
    rows = -(-size_b // STRIPES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best, now, filled = np.zeros(rows * size_a, np.int64), np.zeros(rows * size_a, bool), None, []
        out: list[tuple] = []
        for stripe, kind, block, at, pairs, counts, top in _by_stripe(batches):
            if stripe != now:
                for place in filled:
                    matrix[place], best[place] = 0, False
                now, filled = stripe, []
            place = pairs // size_a // STRIPES * size_a + pairs % size_a
            if kind == 0:
                matrix[place], best[place] = counts, top
                filled.append(place)
            else:
                out.append((stripe, 1, block, at.tobytes(), None, matrix[place].tobytes(), best[place].tobytes()))
                if len(out) >= 500:
                    yield _rows(_SIDE, out)
                    out = []
        if out:
            yield _rows(_SIDE, out)

    both = cells.unionByName(requests.withColumn("counts", F.lit(None).cast("binary")))
    return both.repartition("stripe").sortWithinPartitions("stripe", "kind").mapInArrow(score, _SIDE_DDL)


_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_OUT = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _documents(table: DataFrame, scores: DataFrame) -> DataFrame:
    """Each block's scores meet its documents."""
    own = [n for n in table.columns if n not in ("block", "pairs", "counts")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = counts = best = None

        def out() -> pa.RecordBatch:
            doc_units, units, unit_links, links = (_unpacked(docs[n], t) for n, t in (("doc_units", np.int64), ("units", np.int32), ("unit_links", np.int64), ("links", np.int32)))
            of_unit = [arrays.sums(x[links], unit_links) for x in (best, counts)]
            n_best, total = (arrays.sums(x[units], doc_units) for x in of_unit)
            return arrays.columns(_OUT, docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_links"], docs["n_links"], n_best, total, docs["sha"])

        for batch in batches:
            for k in range(len(batch)):
                if batch.column(1)[k].as_py() == 0:
                    if docs is not None:
                        yield out()
                    docs = {n: batch.column(n)[k].as_py() for n in own}
                    counts, best = np.zeros(docs["size"], np.int64), np.zeros(docs["size"], np.int64)
                else:
                    at = np.frombuffer(batch.column("at")[k].as_py(), np.int32)
                    counts[at] = np.frombuffer(batch.column("counts")[k].as_py(), np.int64)
                    best[at] = np.frombuffer(batch.column("best")[k].as_py(), bool)
        if docs is not None:
            yield out()

    nothing = {n: F.lit(None).cast(dict(table.dtypes)[n]).alias(n) for n in own}
    asked = [F.lit(None).cast("binary").alias(n) for n in ("at", "counts", "best")]
    left = table.select("block", F.lit(0).alias("kind"), *own, *asked)
    right = scores.select("block", "kind", *nothing.values(), "at", "counts", "best")
    return left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind").mapInArrow(fold, _OUT_DDL)


def align(docs: DataFrame, a_path: str, b_path: str, scope: str = "query") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`.

    Texts that are null or empty, or that a side does not spell byte by byte (a text that holds U+2581), have no tokens:
    zeros and ''. Repeated rows count each, null ids stay null, other columns are ignored, and an empty table gives no
    row. Several best counts of one B id are all best.
    """
    size_a, size_b = _vocabulary(a_path, b_path)
    table = store.keep(blocks(docs, a_path, b_path), scope)
    requests = _requests(table, size_a)
    return _documents(table, _scores(_cells(requests, size_a, size_b), requests, size_a, size_b))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, scope: str = "query") -> DataFrame:
    """a_id, b_id, count and best (whether no A id has a higher count with this B id) of every id pair that is linked."""
    size_a, size_b = _vocabulary(a_path, b_path)
    cells = _cells(_requests(store.keep(blocks(docs, a_path, b_path), scope), size_a), size_a, size_b)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, pairs, counts, best in _by_stripe(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pairs % size_a), pa.array(pairs // size_a), pa.array(counts), pa.array(best)], names=["a_id", "b_id", "count", "best"])

    return cells.mapInArrow(unpack, "a_id long, b_id long, count long, best boolean")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and groups, `a1,a2|b1;a3|b2,b3`, of every row of `docs`; '' for texts without tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, entries, first, known in _written(batches, a_path, b_path):
            order = entries.tolist()
            texts = [b"" if 0 in (own := order[x:y]) else b";".join([known.groups[e] for e in own]) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([t.decode() for t in texts])], names=["doc_id", "groups"])
            if known.full():
                known.reset()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, groups string")
