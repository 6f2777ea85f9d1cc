"""Filters on spans and resolution of overlaps. Arrays in, arrays out; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.functions import catalog
from veilstone.functions.spans import SPAN


def by_priority(spans: Column) -> Column:
    """Left to right: a span that begins before the last kept one ends replaces it if its priority is strictly higher,
    else it goes. (A replaced span's head or tail may stay uncovered; `strict` does not leave any.)"""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (s["start"] >= last["end"]), F.array_append(kept, s)).when(s["neg"] < last["neg"], F.array_append(F.slice(kept, 1, F.size(kept) - 1), s)).otherwise(kept)

    return _fold(F.array_sort(spans), step)


def by_score(spans: Column) -> Column:
    """Left to right, higher scores first among equal starts: a span that begins before the last kept one ends goes."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["score"]).alias("b"), s["ord"].alias("c"), s.alias("s"))))

    def step(kept: Column, s: Column) -> Column:
        return F.when((F.size(kept) == 0) | (s["start"] >= F.element_at(kept, -1)["end"]), F.array_append(kept, s)).otherwise(kept)

    return _fold(F.transform(ordered, lambda o: o["s"]), step)


def strict(spans: Column, text: Column) -> Column:
    """Overlapping spans become one, from the first start to the last end, named after that of highest priority."""

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        better = s["neg"] < last["neg"]
        pick = lambda n: F.when(better, s[n]).otherwise(last[n]).alias(n)
        end = F.greatest(last["end"], s["end"])
        value = F.substring(text, last["start"] + 1, end - last["start"])
        both = F.struct(last["start"].alias("start"), pick("neg"), pick("ord"), end.alias("end"), pick("label"), pick("category"), pick("score"), value.alias("value"))
        return F.when((F.size(kept) == 0) | (s["start"] >= last["end"]), F.array_append(kept, s)).otherwise(F.array_append(F.slice(kept, 1, F.size(kept) - 1), both))

    return _fold(F.array_sort(spans), step)


def _fold(spans: Column, step) -> Column:
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(spans) <= 1, spans).otherwise(F.aggregate(spans, empty, step))


def over_threshold(spans: Column, threshold: float = catalog.SCORE_THRESHOLD, overrides: dict[str, float] | None = None) -> Column:
    """Spans whose score reaches the threshold and the override of their label, if it has one."""
    held = catalog.SCORE_OVERRIDES if overrides is None else overrides
    if not held:
        return F.filter(spans, lambda s: s["score"] >= threshold)
    least = F.create_map(*(F.lit(x) for k, v in held.items() for x in (k, float(v))))
    return F.filter(spans, lambda s: s["score"] >= F.greatest(F.lit(float(threshold)), F.coalesce(F.element_at(least, s["label"]), F.lit(float(threshold)))))


def without_labels(spans: Column, labels: list[str]) -> Column:
    return F.filter(spans, lambda s: ~s["label"].isin(*labels)) if labels else spans


def not_overlapping(spans: Column, others: Column) -> Column:
    """Spans that touch none of `others`."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def named_entities(raw: Column, found: Column, ordinal: int = 10_000) -> Column:
    """Spans of a recogniser's array of (name, start, end, value): its names mapped, unknown ones dropped; dates, numbers
    and sums go where a rule found exactly the same span."""
    labels = F.create_map(*(F.lit(x) for k, (label, _) in catalog.NER_LABELS.items() for x in (k, label)))
    categories = F.create_map(*(F.lit(x) for k, (_, category) in catalog.NER_LABELS.items() for x in (k, category)))
    known = F.filter(raw, lambda e: F.element_at(labels, e["name"]).isNotNull() & ~(e["name"].isin(*catalog.NER_YIELDS) & F.exists(found, lambda f: (f["start"] == e["start"]) & (f["end"] == e["end"]))))
    return F.transform(known, lambda e: F.struct(e["start"].cast("int").alias("start"), F.lit(-5).alias("neg"), F.lit(ordinal).alias("ord"), e["end"].cast("int").alias("end"), F.element_at(labels, e["name"]).alias("label"), F.element_at(categories, e["name"]).alias("category"), F.lit(1.0).alias("score"), e["value"].alias("value")))


def exploded(df: DataFrame, spans: str, *keys: str) -> DataFrame:
    """A row for each span: the keys and the span's fields.

    The outer form, as the inner one makes the optimizer push a test of the array's size below the detection, where it is
    evaluated a second time, with every stage's expression written out in it.
    """
    return df.select(*keys, F.inline_outer(spans)).filter(F.col("label").isNotNull())
