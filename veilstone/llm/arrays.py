"""Vectorised text primitives over Arrow string columns: bytes, words, lines and their 64-bit hashes.

A hash is the sum of (random 64-bit value of a byte) * BASE^(position in the unit), modulo 2^64, then mixed.
The random values are drawn from a fixed seed, so every executor and every run gets the same hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
#: True for bytes that begin a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80

_MALLOC_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def byte_values(seed: int, fold_case: bool = False, zero: tuple[int, ...] = ()) -> np.ndarray:
    """Random values of the 256 bytes; bytes in `zero` do not count, A-Z can count as a-z."""
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    values[list(zero)] = 0
    return values


WORD_VALUES = byte_values(11, zero=SPACE_BYTES)
FOLDED_VALUES = byte_values(11, fold_case=True, zero=SPACE_BYTES)
LINE_VALUES = byte_values(12, zero=(0x0A,))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 4096), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row; memory follows them and not the batch."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, end
        start = end


def text_slices(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
    trim()


def trim() -> None:
    """Give freed memory back to the system, which else stays with a Python worker from one stage to the next."""
    pa.default_memory_pool().release_unused()
    if _MALLOC_TRIM is not None:
        _MALLOC_TRIM(0)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of each row (one more entry than rows)."""
    inside = is_word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] |= inside[cuts]
    closes[cuts - 1] |= inside[cuts - 1]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def unit_hashes(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to the next one; bytes of value 0 at a unit's end leave it unchanged."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = starts - starts[0]
    part = values[data[starts[0] :]]
    position = np.arange(len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
    part *= _powers(int(position.max()) + 1)[position]
    return mix(np.add.reduceat(part, at))


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of \\n-split lines; an empty last line of a row is left out."""
    rows = offsets[:-1][np.diff(offsets) > 0]
    starts = np.unique(np.concatenate((rows, np.flatnonzero(data == 0x0A) + 1)))
    return starts[starts < len(data)]


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive units of one row, and the number of each window's first unit."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out += hashes[k : last + k] * mix(np.array([2 * k + 1], np.uint64))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    return mix(out[at]), at


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `flags` over each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the same hash occurs elsewhere in the same row."""
    keys = mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def columns(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
