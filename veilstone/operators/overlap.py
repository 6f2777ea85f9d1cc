"""Spans against spans as rows: those of one table that overlap none of another's, without listing pairs.

Spans are cut at the bounds of bins of positions, so that a long text, or a third of all rows under one key, is spread
over tasks. Within a bin one sweep tells overlaps: of the other table's spans, the greatest end among those that begin at
or before a span, and the least start among those behind its start. Equal spans are told once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions to a bin.
BIN = 4096


def _binned(spans: DataFrame, key: str, start: str, end: str, width: int, side: int) -> DataFrame:
    """Distinct (key, from, to), a row for each bin that a span is in, with the part of it that is in the bin."""
    one = spans.filter(F.col(key).isNotNull() & (F.col(start) < F.col(end))).select(F.col(key).alias("_key"), F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to")).distinct()
    first, last = F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)
    cut = one.withColumn("_bin", F.explode(F.sequence(first, last)))
    return cut.withColumns({"_a": F.greatest("_from", F.col("_bin") * width), "_b": F.least("_to", (F.col("_bin") + 1) * width), "_side": F.lit(side)})


def overlapped(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """The distinct (key, start, end) of `left` that overlap a span of `right` under the same key. Ends are exclusive, empty
    spans overlap nothing, and rows without a key, start or end overlap nothing."""
    both = _binned(left, key, start, end, width, 0).unionByName(_binned(right, key, start, end, width, 1))
    order = Window.partitionBy("_key", "_bin").orderBy("_a")
    other = F.col("_side") == 1
    reached = F.max(F.when(other, F.col("_b"))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(other, F.col("_a"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    swept = both.withColumns({"_reached": reached, "_ahead": ahead}).filter("_side = 0")
    hit = swept.filter((F.col("_reached") > F.col("_a")) | (F.col("_ahead") < F.col("_b")))
    kinds = {f.name: f.dataType for f in left.schema.fields}
    return hit.select(F.col("_key").alias(key), F.col("_from").cast(kinds[start]).alias(start), F.col("_to").cast(kinds[end]).alias(end)).distinct()


def without_overlap(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """The rows of `left`, all columns, that overlap no span of `right` under the same key."""
    return left.join(overlapped(left, right, key, start, end, width), [key, start, end], "left_anti")


def not_repeated(left: DataFrame, right: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """The rows of `left` of which `right` has no span with the same key, start and end."""
    return left.join(right.select(key, start, end).distinct(), [key, start, end], "left_anti")
