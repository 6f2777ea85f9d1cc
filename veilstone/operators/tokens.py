"""Numbered tokens [LABEL_N], rewriting of texts, token maps and their reversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone import tables

_FIELDS = ("start", "end", "label", "category", "score", "value")


def _entity(s: Column, named: Column) -> Column:
    return F.struct(*(s[f].alias(f) for f in _FIELDS), named.alias("token"))


def numbered(spans: Column, consistent: bool = True, value_only: bool = False) -> Column:
    """Entities (start, end, label, category, score, value, token) of resolved spans, numbered in order of appearance.

    Consistent: a label and value keep the number of their first place (with `value_only`, a value keeps the token of
    its first place whatever its label). Else every entity gets the next number of its label.
    """
    if not consistent:
        return F.transform(spans, lambda s, i: _entity(s, token(s["label"], F.size(F.filter(F.slice(spans, 1, i + 1), lambda o: o["label"] == s["label"])))))
    if not value_only:
        return F.transform(spans, lambda s: _entity(s, token(s["label"], F.array_position(F.array_distinct(F.transform(F.filter(spans, lambda o: o["label"] == s["label"]), lambda o: o["value"])), s["value"]))))
    # Each step is an element of an array, so that the next one reads it and does not evaluate it again for every span.
    values = F.transform(spans, lambda s: s["value"])
    firsts = _with(values, lambda v: F.transform(F.array_distinct(v), lambda x: F.element_at(spans, F.array_position(v, x).cast("int"))))
    return _with(firsts, lambda f: _with(_first_tokens(f), lambda named: F.transform(spans, lambda s: _entity(s, F.element_at(named["token"], F.array_position(named["value"], s["value"]).cast("int"))))))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _first_tokens(firsts: Column) -> Column:
    """Struct of the values and the tokens of the first spans of each value: a label's values are numbered in their order."""
    labels = F.array_distinct(F.transform(firsts, lambda f: f["label"]))
    held = F.transform(labels, lambda x: F.struct(x.alias("label"), F.transform(F.filter(firsts, lambda f: f["label"] == x), lambda f: f["value"]).alias("values")))
    named = F.flatten(F.transform(held, lambda h: F.transform(h["values"], lambda v, i: F.struct(v.alias("value"), token(h["label"], i + 1).alias("token")))))
    return _with(named, lambda n: F.struct(F.transform(n, lambda x: x["value"]).alias("value"), F.transform(n, lambda x: x["token"]).alias("token")))


def token(label: Column, number: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), number.cast("string"), F.lit("]"))


def rewritten(text: Column, entities: Column) -> Column:
    """The text with each entity's span replaced by its token."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(entities, start, lambda a, e: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, e["start"] - a["at"]), e["token"]).alias("out"), e["end"].alias("at")), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(entities) == 0, text).otherwise(done)


def token_map(entities: Column) -> Column:
    """Token to value."""
    pairs = F.array_distinct(F.transform(entities, lambda e: F.struct(e["token"].alias("key"), e["value"].alias("value"))))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(unique)


def restored(redacted: Column, tokens: Column) -> Column:
    """The text with every token of the map put back. Tokens that were in the original text are replaced as well."""
    parts = F.split(redacted, r"(?<=\])|(?=\[[A-Z0-9_]+_\d+\])", -1)
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(tokens, p), p)), "")


def corpus_tokens(entities: DataFrame, order: list[str], key: tuple[str, ...] = ("label", "value")) -> DataFrame:
    """The numbering of a whole corpus: label, value, number and token of each distinct label and value.

    `entities` has a row for each entity, `order` the columns that put them in order of arrival. Values are gathered
    first (partial aggregation before the shuffle); numbers come from ranges of the order, so no label meets in one task.
    """
    first = entities.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return ranged_number(first, "label", "_first").withColumn("token", token(F.col("label"), F.col("number"))).select(*key, "number", "token")


def ranged_number(df: DataFrame, group: str, order: str, weight: str | None = None, scope: str = "query") -> DataFrame:
    """Adds `number`, the place of each row within its group, or the sum of `weight` up to it: ranges are numbered apart,
    then shifted by the counts of the ranges in front of them (one row a range and group). Rows have to differ in
    (group, order). The dealt rows are written once, so that numbers and counts are of the same ranges."""
    one = F.lit(1) if weight is None else F.col(weight)
    ranged = tables.keep(df.repartitionByRange(F.col(group), F.col(order)).withColumn("_part", F.spark_partition_id()), scope)
    so_far = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_n", F.sum(one).over(so_far))
    counts = ranged.groupBy(group, "_part").agg(F.sum(one).alias("_size"))
    in_front = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_size").over(in_front), F.lit(0))).drop("_size")
    return local.join(shifts, [group, "_part"]).withColumn("number", (F.col("_n") + F.col("_shift")).cast("long")).drop("_n", "_part", "_shift")
