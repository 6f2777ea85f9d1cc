"""Token counts by a compiled finite-state tokenizer.

A vocabulary of byte-pair pieces is compiled, transition by transition as texts need them, into a deterministic
transducer. A state stands for all prefixes with the same future: the longest suffix that can still grow into a
piece, and for each position inside it the last piece of the tokenization that ends there. A transition carries
the change in the number of emitted tokens. Which piece ends a prefix is decided by pairs: a tokenization is the
right one if and only if each two neighbouring pieces survive being tokenized together.

Texts are cut into chunks that run in lockstep. From the first position at which any two runs meet (a new word, a
character outside the vocabulary) a chunk's map of entry to exit state is constant. The map of a chunk without
such a position is filled as needed: it runs from a guessed entry, and a run from another entry ends where it meets that
one. A scan over the chunks composes these maps, which gives each chunk its entry, with all entries that maps still lack
run at once; what lies in front of a meeting point then runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays

#: What sentencepiece puts for a blank, and in front of a text that is not empty.
MARK = "▁"
CHUNK = 256
#: States and character classes whose transitions stand in a plain table; those of others are hashed.
DENSE, CLASSES = 1 << 16, 192
#: Slots of the hashed table, as a power of two; a table that fills up is compiled anew, which changes no result.
TABLE_BITS = 20
_BIAS = 128


def pair_rank_tokenize(symbols: list[str], ranks: dict[str, int]) -> list[str]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return symbols
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def last_merge(piece: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """The two pieces whose merge makes `piece`; None if its own text is tokenized in another way."""
    symbols = list(piece)
    while len(symbols) > 2:
        pairs = [ranks.get(symbols[i] + symbols[i + 1], len(ranks)) for i in range(len(symbols) - 1)]
        at = pairs.index(min(pairs))
        if pairs[at] == len(ranks):
            return None
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols[0], symbols[1]


class Transducer:
    """Counts tokens of texts by the pieces in `ranks` (piece: merge rank, blanks written as MARK)."""

    def __init__(self, ranks: dict[str, int]):
        if any(MARK in piece.lstrip(MARK) for piece in ranks):
            raise ValueError("a piece holds a blank behind another character; words are not independent")
        self.chars = {c for piece in ranks for c in piece}
        if not self.chars <= ranks.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.ranks = ranks
        self.split = {p: last_merge(p, ranks) for p in ranks if len(p) > 1}
        self.pieces = {p for p in ranks if len(p) == 1 or self.split[p]}
        #: The pieces that a prefix can still grow into.
        self.longer: dict[str, list[str]] = {}
        for p in self.pieces:
            for i in range(1, len(p)):
                self.longer.setdefault(p[:i], []).append(p)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.growing: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.class_of = np.full(0x110000, -1, np.int16)
        self.classes: list[str | int] = [MARK, 1, 2, 3, 4]  # an int: a character outside the vocabulary, of so many bytes
        self.class_of[ord(MARK)] = self.class_of[32] = 0
        # Packed transitions, 0 where not compiled, by state and class; the last row and column stay empty.
        self.dense = np.zeros((DENSE + 1) * CLASSES, np.int32)
        # Those of further states and classes in open addressing: keys, packed values.
        self.keys = np.full(1 << TABLE_BITS, -1, np.int64)
        self.values = np.zeros(1 << TABLE_BITS, np.int32)
        self.filled = 0
        #: suffix; positions in it from which a piece can grow, with the last piece and the count there (against
        #: the end); the last piece at the end
        self.fresh = self.intern(("", (), ""))
        self.word = self.intern((MARK, ((0, "", -1),), MARK))

    def intern(self, state: tuple) -> int:
        found = self.number.get(state)
        if found is None:
            found = self.number[state] = len(self.states)
            self.states.append(state)
        return found

    def fits(self, left: str, right: str) -> bool:
        if not left or MARK in right[0] and left[-1] != MARK:
            return True
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self.survives(left, right)
        return found

    def grows(self, left: str, prefix: str) -> bool:
        """Whether a longer piece that begins with `prefix` can follow `left`."""
        key = (left, prefix)
        found = self.growing.get(key)
        if found is None:
            longer = self.longer.get(prefix, ())
            if len(self.growing) > 2_000_000:
                self.growing.clear()
            found = self.growing[key] = len(longer) > 0 and (len(longer) > 200 or any(self.fits(left, p) for p in longer))
        return found

    def survives(self, a: str, b: str) -> bool:
        """Undo the merges next to the boundary, last first; none across it may come earlier than what is undone."""
        limit = len(self.ranks)
        while True:
            if self.ranks.get(a + b, limit) < limit:
                return False
            left, right = (self.ranks[a] if len(a) > 1 else -1), (self.ranks[b] if len(b) > 1 else -1)
            if left > right:
                limit, a = left, self.split[a][1]
            elif right >= 0:
                limit, b = right + 1, self.split[b][0]
            else:
                return True

    def compile(self, state: int, kind: int) -> int:
        """The packed transition: next state, change in the count."""
        suffix, held, last = self.states[state]
        char = self.classes[kind]
        if isinstance(char, int):
            to, change = self.fresh, char
        elif char == MARK and last[-1:] != MARK:
            to, change = self.word, 1
        else:
            grown, held = suffix + char, (*held, (len(suffix), last, 0))
            change = None
            for k, before, counted in held:
                piece = grown[k:]
                if piece in self.pieces and self.fits(before, piece):
                    change = counted + 1
                    break
            if change is None:
                raise AssertionError(f"no piece ends {grown!r}")
            # Positions from which no piece can grow, here or behind that last piece, don't matter to what follows.
            kept = [(k, before, counted - change) for k, before, counted in held if self.grows(before, grown[k:])]
            cut = kept[0][0] if kept else len(grown)
            to = self.intern((grown[cut:], tuple((k - cut, p, c) for k, p, c in kept), piece))
        packed = to << 8 | (change + _BIAS)
        return packed

    def look_up(self, states: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """The packed transitions; those that are met first are compiled."""
        at = np.minimum(states, DENSE) * CLASSES + np.minimum(kinds, CLASSES - 1)
        packed = self.dense[at]
        if not packed.all():
            off = np.flatnonzero(packed == 0)
            far = (states[off] >= DENSE) | (kinds[off] >= CLASSES - 1)
            for key in np.unique(at[off[~far]]).tolist():
                self.dense[key] = self.compile(*divmod(key, CLASSES))
            packed[off] = self.dense[at[off]]
            if far.any():
                packed[off[far]] = self.hashed(states[off[far]] << 16 | kinds[off[far]])
        return packed

    def hashed(self, keys: np.ndarray) -> np.ndarray:
        """The packed transitions of keys (state << 16 | class)."""
        at = self.slot(keys)
        held = self.keys[at]
        if (off := np.flatnonzero(held != keys)).size:
            self.probe(keys, at, off)
        return self.values[at]

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * -7046029254386353131) >> (64 - TABLE_BITS)) & ((1 << TABLE_BITS) - 1)

    def probe(self, keys: np.ndarray, at: np.ndarray, off: np.ndarray) -> None:
        """Move `at` on for the keys in `off`; compile those that aren't held."""
        while off.size:
            free = self.keys[at[off]] < 0
            for key in np.unique(keys[off[free]]):
                value, k = self.compile(int(key) >> 16, int(key) & 0xFFFF), int(self.slot(np.array([key]))[0])
                while self.keys[k] >= 0:
                    k = (k + 1) & ((1 << TABLE_BITS) - 1)
                self.keys[k], self.values[k] = key, value
                self.filled += 1
            off = off[self.keys[at[off]] != keys[off]]
            at[off] = (at[off] + 1) & ((1 << TABLE_BITS) - 1)
            off = off[self.keys[at[off]] != keys[off]]

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code point."""
        out = self.class_of[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]):
                char = chr(code)
                if char in self.chars:
                    self.class_of[code] = len(self.classes)
                    self.classes.append(char)
                else:
                    self.class_of[code] = len(char.encode())
            out = self.class_of[codes]
        return out

    def run(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each run over kinds[start:end]."""
        order = np.argsort(starts - ends, kind="stable")
        at, lengths, now = starts[order], (ends - starts)[order], states[order].astype(np.int64)
        counts = np.zeros(len(order), np.int64)
        live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        for step, n in enumerate(live):
            packed = self.look_up(now[:n], kinds[at[:n] + step])
            now[:n] = packed >> 8
            counts[:n] += packed & 255
        counts -= _BIAS * lengths
        exits, total = np.empty_like(now), np.empty_like(counts)
        exits[order], total[order] = now, counts
        return exits, total

    def trace(self, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and counts on the way of each run over kinds[start:end]: a row each, its place in the run along it."""
        size = ends - starts
        width = int(size.max(initial=0))
        trail, sums = np.zeros((len(starts), width + 1), np.int64), np.zeros((len(starts), width + 1), np.int64)
        trail[:, 0] = states
        live = np.arange(len(starts))
        for step in range(width):
            live = live[size[live] > step]
            packed = self.look_up(trail[live, step], kinds[starts[live] + step])
            trail[live, step + 1] = packed >> 8
            sums[live, step + 1] = sums[live, step] + (packed & 255) - _BIAS
        return trail, sums

    def rejoin(self, kinds: np.ndarray, starts: np.ndarray, size: np.ndarray, states: np.ndarray, trail: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of each run, which is that of its trail from where it meets it."""
        now, counts, step = states.astype(np.int64), np.zeros(len(starts), np.int64), 0
        live = np.arange(len(starts))
        while live.size:
            met = trail[live, step] == now[live]
            on = live[met]
            counts[on] += sums[on, size[on]] - sums[on, step]
            now[on] = trail[on, size[on]]
            live = live[~met]
            live = live[size[live] > step]
            packed = self.look_up(now[live], kinds[starts[live] + step])
            now[live] = packed >> 8
            counts[live] += (packed & 255) - _BIAS
            step += 1
        return now, counts

    def counts(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text codes[offsets[i]:offsets[i + 1]]."""
        if self.filled > 0.6 * len(self.keys):
            self.reset()
        lengths = np.diff(offsets)
        out = (lengths > 0).astype(np.int64)  # the mark in front
        if not len(codes):
            return out
        kinds = self.kinds(codes)
        per_row = -(-lengths // CHUNK)
        row = np.repeat(np.arange(len(lengths)), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        starts = offsets[row] + nth * CHUNK
        ends = np.minimum(starts + CHUNK, offsets[row + 1])
        meets = (kinds >= 1) & (kinds <= 4)
        meets[1:] |= (kinds[1:] == 0) & (kinds[:-1] != 0)
        meets[offsets[:-1][lengths > 0]] &= kinds[offsets[:-1][lengths > 0]] != 0
        points = np.append(np.flatnonzero(meets), len(kinds))
        cut = np.minimum(points[np.searchsorted(points, starts)], ends)
        exits, total = self.run(kinds, cut, ends, np.full(len(row), self.fresh))
        known, head = cut < ends, nth == 0
        # Chunks without a meeting point: their maps, from entry to exit state and count, are filled from a guess on. A walk
        # along the chunks hands on exit states; entries that a map lacks are run at once for all chunks.
        loose = np.flatnonzero(~known)
        guess = np.where(head, self.word, self.fresh)[loose]
        trail, sums = self.trace(kinds, starts[loose], ends[loose], guess)
        size = ends[loose] - starts[loose]
        at_end = np.arange(len(loose)), size
        maps = [{g: found} for g, *found in zip(guess.tolist(), trail[at_end].tolist(), sums[at_end].tolist(), strict=True)]
        through, heads, places = exits.tolist(), head.tolist(), loose.tolist()
        rounds = 0
        while maps:
            lacking, rounds = [], rounds + 1
            for i, c in enumerate(places):
                enters = self.word if heads[c] else through[c - 1]
                found = maps[i].get(enters)
                if found is None:
                    lacking.append((i, enters))
                else:
                    through[c], total[c] = found
            if not lacking:
                break
            if rounds > 2:  # an entry that no guess meets, as in periodic texts, is likely that of the chunks behind, too
                more = {(j, enters) for i, enters in lacking for j in range(i + 1, min(i + (1 << rounds), len(places))) if not heads[places[j]] and enters not in maps[j]}
                lacking += sorted(more.difference(lacking))
            which, entered = np.array(lacking, np.int64).T
            ran = self.rejoin(kinds, starts[loose[which]], size[which], entered, trail[which], sums[which])
            for (i, enters), *found in zip(lacking, *(x.tolist() for x in ran), strict=True):
                maps[i][enters] = found
        entry = np.where(head, self.word, np.roll(np.array(through, np.int64), 1))
        _, more = self.run(kinds, starts[known], cut[known], entry[known])
        total[known] += more
        np.add.at(out, row, total)
        return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lead = np.concatenate(([0], np.cumsum(arrays.IS_LEAD[data], dtype=np.int64)))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), lead[offsets]


def sentencepiece_ranks(model_path: str) -> dict[str, int]:
    """Pieces of a BPE model by merge order. The model must keep blanks and must not normalise."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    by_score = sorted(pieces, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): k for k, i in enumerate(by_score)}


_COMPILED: dict[str, Transducer] = {}

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of `docs`.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row of their own; other
    columns are neither read nor returned. One scan, no shuffle; memory follows slices of texts, and a text that is
    longer than a slice is taken whole.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _COMPILED.get(model_path)
        if machine is None:
            machine = _COMPILED[model_path] = Transducer(sentencepiece_ranks(model_path))
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                sizes[a:b] = np.diff(offsets)
                tokens[a:b] = machine.counts(*code_points(data, offsets))
            yield arrays.columns(SCHEMA, batch.column(0), sizes, tokens)

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
