"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its word shingles (tokens), held as 64-bit hashes. Exact copies of a set fall together first.
Tokens are ranked by a counting table over all documents, and each set is ordered by rank, from rare to frequent, then
by hash.

With threshold t, two linked sets x and y miss at most A = (1-t)|x| tokens of x, and differ in at most D = (1-t)/t |x|
tokens together. So their first shared token is among the first A+1 of both: these tokens are the single keys. A key that
few sets hold is a rare token, and all pairs of its bucket are candidates whose places leave room for enough common
tokens behind their first one. A key that more than LIGHT sets hold is a frequent token. Sets with such a key extend
their prefix, and runs of k consecutive tokens are their keys: a differing token breaks at most k runs, so one of the
first kD+1 runs is common to both. Sets too short for kD+1 runs, and those that they may be linked with, are keyed by
shorter runs as well. No linked pair is lost, and a passage that many documents share hardly ever fills k places in a
row in two of them.

Parity bits of the sets rule out most candidates. The rest is verified in rounds, as only components are asked for. First
each set meets one partner: its least candidate, or the leader of one of its FEW least runs (the member of fewest rare
tokens, the centre of a group of near copies). Then sets with runs are gathered in pieces, where a run is listed once for
each component, with its leader and its members. A run of one component is done with. Of the others, the components'
leaders meet, as long as that links any. At last only members of runs that are still of several components are listed one
by one, and only candidates that are still in different components meet. So a group of near copies moves a few times,
however many copies and runs it has, and no bucket is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm import arrays, store
from veilstone.llm.components import components

#: Cells of the counting table, and the blocks that it is summed by. A cell's level is a byte.
CELLS, BLOCKS = 1 << 24, 64
_SHIFT = np.uint64(40)
#: Levels grow with the logarithm of a cell's count over an even spread's noise; a token below this one counts as rare.
FREQUENT = 53
#: 64-bit words of a set's parity bits. Each token flips one bit, so two sets differ by as many tokens as bits at least.
PARITY = 8
#: Consecutive tokens of a run, and the largest bucket of a single token.
RUN, LIGHT = 3, 32
#: Runs that a set looks for a first partner by; rounds in which leaders meet at most (what is left then is listed); and runs
#: that are gathered to a piece.
FEW, ROUNDS, PIECE = 6, 2, 1 << 18
#: Stands for a null id inside; larger than any other.
NO_ID = 2**63 - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within the text, and the offsets of texts in them.

    A text of fewer than n words has its whole sequence as one shingle; one without words has none.
    """
    starts, _, first = arrays.word_spans(data, offsets)
    words = arrays.unit_hashes(data, starts, arrays.FOLDED_VALUES)
    hashes, at = arrays.windows(words, first, n)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows = row[at]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if short.size:
        own = np.array([arrays.mix(np.sum(words[first[i] : first[i + 1]] * arrays.mix(np.arange(101, 101 + first[i + 1] - first[i], dtype=np.uint64)), keepdims=True))[0] for i in short], np.uint64)
        hashes, rows = np.concatenate((hashes, own)), np.concatenate((rows, short))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(offsets)))


def cell_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How frequent the tokens of each cell of the counting table are; a function of all documents, of fixed size.

    Levels decide only how tokens are ordered and keyed, never what is linked.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in arrays.text_slices(batch.column(0)):
                hashes, _ = shingle_sets(data, offsets, n)
                np.add.at(total, (hashes >> _SHIFT).astype(np.int64), np.uint32(1))
        part = TaskContext.get().partitionId()
        yield packed(range(BLOCKS), [part] * BLOCKS, total.reshape(BLOCKS, -1))

    def packed(blocks, parts, counts) -> pa.RecordBatch:
        """Bytes of equal weight stand together, so those of no weight cost next to nothing."""
        planes = [pa.compress(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True) for c in counts]
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(list(parts), pa.int64()), pa.array(planes, pa.binary())], names=["block", "part", "counts"])

    def unpacked(planes: bytes) -> np.ndarray:
        size = CELLS // BLOCKS
        raw = np.frombuffer(pa.decompress(planes, 8 * size, "zstd", asbytes=True), np.uint8)
        return np.ascontiguousarray(raw.reshape(8, size).T).view("<u8").ravel()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, total = 0, 0, np.zeros(CELLS // BLOCKS, "<u8")
        for b in batches:
            for k, p, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                block, part = k, p
                total += unpacked(c)
        yield packed([block], [part], [total])

    ddl = "block int, part long, counts binary"
    table, parts = docs.select("text").mapInArrow(count, ddl), docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 32)
        table = table.withColumn("part", F.expr("part div 32")).groupBy("block", "part").applyInArrow(add, ddl)
    summed: list[list[bytes]] = [[] for _ in range(BLOCKS)]
    for r in table.collect():  # BLOCKS rows; a block is unpacked at a time
        summed[r.block].append(r.counts)
    of = lambda k: sum(map(unpacked, summed[k]), np.zeros(CELLS // BLOCKS, "<u8"))
    noise = math.sqrt(mean := sum(int(of(k).sum()) for k in range(BLOCKS)) / CELLS)
    levels = np.empty((BLOCKS, CELLS // BLOCKS), np.uint8)
    for k in range(BLOCKS):
        above = np.maximum(of(k).astype(np.float32) - np.float32(max(0.0, mean - 4 * noise)), 0)
        levels[k] = np.clip(16 * np.log2(1 + above / np.float32(noise + 1)), 0, 255)
    return levels.ravel()


def bounds(n: int, num: int, den: int) -> tuple[int, int]:
    """Tokens of a set of n that a linked set may miss, and by which the two may differ; none differ: only equal sets link."""
    return (den - num) * n // den, (den - num) * n // num


def singles(ordered: np.ndarray, num: int, den: int) -> np.ndarray:
    miss, differ = bounds(len(ordered), num, den)
    return ordered[: miss + 1] if differ else ordered[:0]


@lru_cache(1 << 16)
def run_lengths(n: int, num: int, den: int) -> tuple[int, ...]:
    """Lengths of the runs that a set of n is keyed by: RUN, and shorter ones as far as the set or one that it may be linked
    with is too short to hold a run for each token that may differ, and one more."""

    def weak(size: int, k: int) -> bool:
        differ = bounds(size, num, den)[1]
        return differ > 0 and size - k + 1 < k * differ + 1

    sizes, lengths = range(-(-n * num // den), n * den // num + 1), [RUN]
    while lengths[-1] > 1 and any(weak(m, lengths[-1]) for m in sizes):
        lengths.append(lengths[-1] - 1)
    return tuple(lengths)


def runs(ordered: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the first runs of consecutive tokens: enough for one in common with any linked set."""
    _, differ = bounds(len(ordered), num, den)
    if not differ:
        return ordered[:0]
    parts = []
    for length in run_lengths(len(ordered), num, den):
        size = max(0, min(len(ordered) - length + 1, length * differ + 1))
        out = np.zeros(size, np.uint64)
        for k in range(length):
            out += ordered[k : k + size] * arrays.mix(np.array([2 * k + 7], np.uint64))
        parts.append(arrays.mix(out + np.uint64(RUN - length)))
    return np.concatenate(parts)


def ordered_sets(data: np.ndarray, offsets: np.ndarray, n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text by (level, hash), their levels, and the offsets of texts in them."""
    hashes, at = shingle_sets(data, offsets, n)
    level = levels[(hashes >> _SHIFT).astype(np.int64)]
    order = np.lexsort((hashes, level, np.repeat(np.arange(len(at) - 1), np.diff(at))))
    return hashes[order], level[order], at


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def parity_bits(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """PARITY words for each set."""
    n = len(at) - 1
    out = np.empty((n, PARITY), np.int64)
    for i in range(0, n, 1024):
        cut = at[i : i + 1025]
        bit = (hashes[cut[0] : cut[-1]] >> np.uint64(8) & np.uint64(64 * PARITY - 1)).astype(np.int64)
        rows = len(cut) - 1
        flips = np.bincount(np.repeat(np.arange(rows), np.diff(cut)) * 64 * PARITY + bit, minlength=rows * 64 * PARITY) & 1
        out[i : i + rows] = np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(rows, PARITY)
    return out


_BITS = [f"p{k}" for k in range(PARITY)]
_PRINTS = "rid long, doc_id long, th long, n long, f1 long, f2 long, " + ", ".join(f"{p} long" for p in _BITS) + ", keys array<long>"


def prints(docs: DataFrame, n: int, num: int, den: int, shared) -> DataFrame:
    """A number of its own (rid), doc_id, hash of the text, set size, 128-bit fingerprint of the set, parity bits and single
    keys of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets in arrays.text_slices(batch.column(2)):
                hashes, _, at = ordered_sets(data, offsets, n, shared.value)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes, dtype=np.uint64)))
                other = np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(hashes), dtype=np.uint64)))
                sums = lambda t: pa.array(arrays.mix(t[at[1:]] - t[at[:-1]]).view(np.int64))  # noqa: B023, E731
                keys = _lists([singles(hashes[i:j], num, den) for i, j in zip(at[:-1], at[1:], strict=True)])
                bits = parity_bits(hashes, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + b - a)), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(at)), sums(total), sums(other), *(pa.array(x) for x in bits.T), keys], names=["rid", "doc_id", "th", "n", "f1", "f2", *_BITS, "keys"])
                rid += b - a

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(scan, _PRINTS)


def sets_of(docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, shared) -> DataFrame:
    """node, its set, its runs (of nodes that are `heavy`) and its number of rare tokens, of the documents whose id is in
    `nodes` (node, heavy). Rows equal in id and text are one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heavy = batch.column(2).to_pylist()
            for a, b, data, offsets in arrays.text_slices(batch.column(1)):
                hashes, level, at = ordered_sets(data, offsets, n, shared.value)
                for i in range(a, b, 256):
                    j = min(i + 256, b)
                    cut = at[i - a : j - a + 1]
                    own = [hashes[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    keys = [runs(x, num, den) if h else x[:0] for x, h in zip(own, heavy[i:j], strict=True)]
                    rare = arrays.sums(level[cut[0] : cut[-1]] < FREQUENT, cut - cut[0])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(own), _lists(keys), pa.array(rare)], names=["node", "shingles", "runs", "n_rare"])

    found = docs.withColumn("th", F.xxhash64("text")).join(nodes.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id")
    one = found.dropDuplicates(["doc_id", "th"]).select("doc_id", "text", "heavy")
    return one.mapInArrow(scan, "node long, shingles array<long>, runs array<long>, n_rare long")


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda name, out: sets.select(F.col("node").alias(name), F.col("shingles").alias(out)).hint("merge")
    both = F.size(F.array_intersect("_x", "_y"))
    reaches = F.lit(den) * both >= F.lit(num) * (F.size("_x") + F.size("_y") - both)
    return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").filter(reaches).select("a", "b").distinct()


def alike(x: str, y: str, num: int, den: int) -> Column:
    """Whether the sizes and parity bits of two sets, columns prefixed `x` and `y`, allow a link."""
    flipped = sum((F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in _BITS), F.lit(0))
    return F.lit(den + num) * flipped <= F.lit(den - num) * (F.col(f"{x}n") + F.col(f"{y}n"))


def close(x: Column, y: Column, num: int, den: int) -> Column:
    return F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)


def light_pairs(buckets: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of a bucket (key, node, n, pos) of LIGHT rows at most that may be linked."""
    listed = buckets.groupBy("key").agg(F.collect_list(F.struct("node", "n", "pos")).alias("m"))
    room = lambda x, y: F.lit(den + num) * F.least(x["n"] - x["pos"], y["n"] - y["pos"]) >= F.lit(num) * (x["n"] + y["n"])
    behind = lambda x, i: F.filter(F.slice("m", i + 2, LIGHT), lambda y: room(x, y) & (x["node"] != y["node"]))
    pair = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
    # The outer form: the inner one makes the optimizer test the array's size below, which lists the pairs twice.
    pairs = listed.select(F.inline_outer(F.flatten(F.transform("m", lambda x, i: F.transform(behind(x, i), lambda y: pair(x, y)))))).filter("a is not null").distinct()
    side = lambda name: heads.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *_BITS))).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(alike("a_", "b_", num, den)).select("a", "b").distinct()


_PIECES = "key long, component long, n_rare long, leader long, n long, nodes array<long>"


def run_pieces(placed: DataFrame) -> DataFrame:
    """Sets (node, n, n_rare, component, runs) by run and component: for each piece of the sets the member of fewest rare
    tokens, its size, and all members."""

    def told(keys: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(k) for k in keys])
        node, n, n_rare, component = (np.repeat(c, sizes) for c in np.array(rows).T)
        key = np.concatenate(keys)
        order = np.lexsort((node, n_rare, component, key))
        key, component = key[order], component[order]
        head = np.ones(len(order), bool)
        head[1:] = (key[1:] != key[:-1]) | (component[1:] != component[:-1])
        first = np.flatnonzero(head)
        nodes = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(node[order]))
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key[first], component[first], n_rare[order[first]], node[order[first]], n[order[first]])), nodes], names=["key", "component", "n_rare", "leader", "n", "nodes"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        held = 0
        for batch in batches:
            own = np.array([batch.column(k).to_numpy() for k in range(4)]).T
            for k, runs in enumerate(batch.column(4)):
                keys.append(runs.values.to_numpy())
                rows.append(own[k])
                held += len(keys[-1])
                if held >= PIECE:
                    yield told(keys, rows)
                    keys, rows, held = [], [], 0
        if held:
            yield told(keys, rows)
        arrays.trim()

    return placed.select("node", "n", "n_rare", "component", "runs").mapInArrow(gather, _PIECES)


def run_links(sets: DataFrame, labels: DataFrame, heads: DataFrame, num: int, den: int, scope: str) -> tuple[DataFrame | None, DataFrame]:
    """Links (a, b), if any, between leaders of components that share a run; and pairs (a, b), still to be verified, of sets that share
    a run, may be linked and are in different components even so."""
    keep = lambda t: store.keep(t, scope)
    sized = sets.filter(F.size("runs") > 0).select("node", F.size("shingles").cast("long").alias("n"), "n_rare", "runs")
    pieces = keep(run_pieces(sized.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))))
    found = now = None  # links so far; of components that were joined since: component, label
    bits = heads.select("node", *_BITS)
    for _ in range(ROUNDS):
        named = _named(pieces, now)
        leader = F.struct("n_rare", "leader", "n")
        by = named.groupBy("key", "component").agg(F.min(leader).alias("l"), F.sum(F.size("nodes")).alias("held"))
        several = by.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("held", "component", "l")).alias("most")).filter("parts > 1")
        open_runs = keep(several.select("key", F.col("most.component").alias("largest"), F.col("most.l").alias("head")))
        met = by.join(open_runs.hint("merge"), "key").filter((F.col("component") != F.col("largest")) & close(F.col("l.n"), F.col("head.n"), num, den))
        pairs = met.select(F.least("l.leader", "head.leader").alias("a"), F.greatest("l.leader", "head.leader").alias("b"), F.when(F.col("l.leader") < F.col("head.leader"), F.struct(F.col("component").alias("x"), F.col("largest").alias("y"), F.col("l.n").alias("m"), F.col("head.n").alias("n"))).otherwise(F.struct(F.col("largest").alias("x"), F.col("component").alias("y"), F.col("head.n").alias("m"), F.col("l.n").alias("n"))).alias("of")).distinct()
        side = lambda name: bits.select(F.col("node").alias(name), *(F.col(p).alias(f"{name}_{p}") for p in _BITS)).hint("merge")
        fits = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"a_n": F.col("of.m"), "b_n": F.col("of.n")}).filter(alike("a_", "b_", num, den))
        asked = keep(fits.select("a", "b", "of.x", "of.y"))
        new = keep(linked(asked.select("a", "b").distinct(), sets, num, den))
        if new.isEmpty():
            break
        joined = asked.join(new.hint("merge"), ["a", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = components(joined, scope).select(F.col("node").alias("component"), F.col("component").alias("label"))
        if now is not None:  # what was joined before goes along
            later = merged.select(F.col("component").alias("_c"), F.col("label").alias("_l"))
            moved = now.join(later, F.col("label") == F.col("_c"), "left").select("component", F.coalesce("_l", "label").alias("label"))
            merged = moved.union(merged.join(now, "component", "left_anti"))
        now, found = keep(merged), new if found is None else keep(found.union(new))
    else:
        by = _named(pieces, now).groupBy("key", "component").agg(F.sum(F.size("nodes")).alias("held"))
        several = by.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("held", "component")).alias("most")).filter("parts > 1")
        open_runs = keep(several.select("key", F.col("most.component").alias("largest")))
    # Of two components one at least is not the run's largest, so only members of the others look for partners. Linked sets
    # are in the same band of sizes or in neighbouring ones.
    listed = _named(pieces, now).join(open_runs.select("key", "largest").hint("merge"), "key").select("key", "largest", "component", F.explode("nodes").alias("node"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(math.log(den / num), 1e-9) * 1.000001))
    rest = keep(listed.join(heads.select("node", "n", *_BITS), "node").withColumn("band", band))
    store.discard(pieces)
    names = ["node", "n", "component", *_BITS]
    x = rest.select("key", "band", *(F.col(c).alias(f"x_{c}") for c in names))
    others = rest.filter(F.col("component") != F.col("largest"))
    y = others.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *(F.col(c).alias(f"y_{c}") for c in names))
    apart = F.col("x_component") != F.col("y_component")
    fits = close(F.col("x_n"), F.col("y_n"), num, den) & alike("x_", "y_", num, den)
    pairs = x.join(y.hint("merge"), ["key", "band"]).filter(apart & fits)
    return found, pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _named(pieces: DataFrame, now: DataFrame | None) -> DataFrame:
    """The pieces under the labels that their components have now."""
    if now is None:
        return pieces
    return pieces.join(now, "component", "left").withColumn("component", F.coalesce("label", "component")).drop("label")


def join(docs: DataFrame, n: int = 5, percent: int = 80, scope: str = "query") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents are linked if 100 * |intersection| >= percent * |union|.

    Words are split at ASCII white space, A-Z count as a-z, a set is the distinct n-word shingles of the whole text
    (fewer words: the whole sequence). component_id is the least id reached by links, the document's own included.
    Documents without words have n_shingles 0 and are linked with nothing. Equal sets are one node, named by the least id
    of their rows; rows that share that id but not the set make their sets one node. A null id counts as larger than any
    other, and a component of null ids alone has a null component_id. Other columns are ignored; an empty table gives no
    row.
    """
    return placed_rows(docs, n, percent, scope).select("doc_id", "n_shingles", "component_id")


def placed_rows(docs: DataFrame, n: int, percent: int, scope: str) -> DataFrame:
    """What join() returns, with the hash of the text (th) and the set's fingerprint (f1, f2)."""
    num, den = percent, 100
    keep = lambda t: store.keep(t, scope)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(cell_levels(docs, n))  # CELLS bytes
    table = keep(prints(docs, n, num, den, shared))
    same = ["n", "f1", "f2"]
    rows = keep(table.select("doc_id", "th", *same))
    groups = keep(table.filter("n > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "rid")).alias("m")).select(*same, F.col("m.doc_id").alias("node"), "m.rid"))
    # One row for each class of equal sets.
    heads = keep(table.filter(F.size("keys") > 0).join(groups.select("rid").hint("merge"), "rid", "left_semi").select(F.col("doc_id").alias("node"), "n", *_BITS, "keys"))
    store.discard(table)

    # Single keys that two or more sets hold, with their number: a frequent key is counted, then joined, never gathered.
    keyed = heads.select("node", "n", F.posexplode("keys").alias("pos", "key"))
    held = keep(keyed.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"))
    buckets = keep(keyed.join(held.hint("merge"), "key"))
    heavy = keep(buckets.filter(F.col("held") > LIGHT).select("node").distinct())
    light = keep(light_pairs(buckets.filter(F.col("held") <= LIGHT), heads, num, den))
    for done in (held, buckets):
        store.discard(done)

    asked = light.select(F.col("a").alias("node"), F.lit(False).alias("heavy")).union(light.select("b", F.lit(False))).union(heavy.select("node", F.lit(True)))
    sets = keep(sets_of(docs, asked.groupBy("node").agg(F.max("heavy").alias("heavy")), n, num, den, shared))

    # First round: one partner for each set.
    least = F.explode(F.slice(F.array_sort("runs"), 1, FEW)).alias("key")
    few = keep(sets.filter(F.size("runs") > 0).select("node", F.size("shingles").cast("long").alias("n"), "n_rare", least))
    leaders = keep(few.groupBy("key").agg(F.min(F.struct("n_rare", "node", "n")).alias("leader")))  # a table, so that a hot key's join is split
    led = few.join(leaders.hint("merge"), "key").filter((F.col("node") != F.col("leader.node")) & close(F.col("n"), F.col("leader.n"), num, den))
    led = led.groupBy("node").agg(F.min("leader").alias("leader")).select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b"))
    stars = keep(light.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(led).distinct())
    labels = components(keep(linked(stars, sets, num, den)), scope)

    # The other rounds: what different components are left.
    own = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    across = light.join(own("a"), "a", "left").join(own("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    found, asked = run_links(sets, labels, heads, num, den, scope)
    across = across.union(asked).distinct()
    late = linked(keep(across.join(stars, ["a", "b"], "left_anti")), sets, num, den)
    late = keep(late if found is None else late.union(found))
    store.discard(sets)
    up = late.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    upper = components(up, scope).select(F.col("node").alias("_n"), F.col("component").alias("_c"))

    told = rows.join(groups.select(*same, "node"), same, "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = told.join(upper, F.col("component") == F.col("_n"), "left")
    null_id = lambda c: F.nullif(c, F.lit(NO_ID))
    return told.select(null_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null_id(F.coalesce("_c", "component", "doc_id")).alias("component_id"), "th", "f1", "f2")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80, scope: str = "query") -> DataFrame:
    """The rows of `docs`, all columns, that stand for their component: those whose id is the component's id.

    Documents without words are linked with nothing and all stay. Of rows that are equal in id and set, one stays.
    """
    found = store.keep(placed_rows(docs, n, percent, scope), scope)
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("n_shingles") > 0))
    one = heads.groupBy("doc_id", "f1", "f2").agg(F.min("th").alias("th")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    none = found.filter("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    stays = store.keep(one.withColumn("_words", F.lit(True)).union(none.withColumn("_words", F.lit(False))), scope)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
    kept = docs.join(stays.hint("merge"), same)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    repeats = found.groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.max("n_shingles").alias("s")).filter("n > 1 and s > 0")
    if repeats.isEmpty():
        return kept.select(*columns)
    # Rows equal in id and text: one of each, any, as they are the same document.
    first = kept.filter("_words").groupBy("_id", "_th").agg(F.first(F.struct(*columns)).alias("_row")).select("_row.*")
    return first.unionByName(kept.filter("not _words").select(*columns))
