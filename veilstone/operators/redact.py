"""Redaction of a text column: detection, resolution, tokens and rewriting in one projection chain, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone import tables
from veilstone.functions import catalog
from veilstone.functions.registry import Detector, Registry, rule_registry, scored_registry
from veilstone.functions.spans import SPAN, Context, candidates, spans_of
from veilstone.operators import resolve, tokens


@dataclass(frozen=True)
class Options:
    """`profile`: "rule" (priorities) or "scored" (scores and thresholds). Without a registry the profile's own is taken.

    `recogniser`, off by default, finds named entities: a function of a list of texts that gives a list of (name, start,
    end) for each. With `skip_failing` a detector that cannot be evaluated is logged and left out, and a text on which the
    recogniser fails goes on without it; the column `detector_errors` tells which.
    """

    profile: str = "rule"
    registry: Registry | None = None
    categories: tuple[str, ...] = ()
    skip_categories: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    skip_labels: tuple[str, ...] = ()
    consistent: bool = True
    strict: bool = False
    threshold: float = catalog.SCORE_THRESHOLD
    overrides: dict[str, float] = field(default_factory=lambda: dict(catalog.SCORE_OVERRIDES))
    context_boost: float = 0.0
    context: Context | None = None
    recogniser: Callable[[list[str]], list[list[tuple[str, int, int]]]] | None = None
    skip_failing: bool = False

    def nearness(self) -> Context | None:
        """`context`, or that of a `context_boost`: a context word anywhere in the text raises a score by so much."""
        return self.context or (Context(self.context_boost, 0.0, None) if self.context_boost else None)

    def detectors(self) -> Registry:
        held = self.registry or (scored_registry() if self.profile == "scored" else rule_registry())
        return held.prune(self.categories, self.skip_categories, self.labels, self.skip_labels)


def resolved(text: Column, found: Column, options: Options) -> Column:
    """The spans that count, of candidate spans."""
    if options.profile == "scored":
        kept = resolve.over_threshold(found, options.threshold, options.overrides)
        return F.when(F.trim(text) == "", F.slice(kept, 1, 0)).otherwise(resolve.by_score(kept))
    return resolve.strict(found, text) if options.strict else resolve.by_priority(found)


def detect(df: DataFrame, text: str = "text", options: Options | None = None, out: str = "entities") -> DataFrame:
    """Adds `out`: entities (start, end, label, category, score, value, token) of the text. A null text has none.

    Stages are columns of their own, so that each is evaluated once: candidates, then resolved spans, then tokens.
    """
    options = options or Options()
    text_col, registry, failed = F.col(text), options.detectors(), {}
    if options.skip_failing:
        registry, failed = registry.checked(df.sparkSession)
    found = df.withColumn("_low", F.lower(text_col))
    stages = [F.col("_found")]
    errors = F.array(*map(F.lit, sorted(failed))).cast("array<string>")
    failures = F.array(*(F.struct(F.lit(label).alias("detector"), F.lit("unusable").alias("kind"), F.lit(told).alias("message")) for label, told in sorted(failed.items()))).cast(FAILURES)
    if scanners := [(k, d) for k, d in enumerate(registry.detectors) if d.enabled and d.scan]:
        found = found.withColumn("_scan", scanned(scanners, options.skip_failing)(text_col))
        stages.append(spans_of(text_col, F.col("_low"), registry, F.col("_scan.found"), options.nearness()))
        errors = F.concat(errors, F.transform("_scan.failures", lambda f: f["detector"]))
        failures = F.concat(failures, F.col("_scan.failures"))
    found = found.withColumn("_found", candidates(text, registry, "_low", options.nearness()))
    if options.recogniser:
        found = found.withColumn("_named", _recognised(options.recogniser, options.skip_failing)(text_col))
        values = F.transform("_named.entities", lambda e: F.struct(e["name"].alias("name"), e["start"].alias("start"), e["end"].alias("end"), F.substring(text_col, e["start"] + 1, e["end"] - e["start"]).alias("value")))
        stages.append(F.coalesce(resolve.named_entities(values, F.col("_found")), F.array().cast(f"array<{SPAN}>")))
        errors = F.when(F.col("_named.failed"), F.array_append(errors, F.lit("recogniser"))).otherwise(errors)
    if len(stages) > 1:
        found = found.withColumn("_found", F.array_sort(F.concat(*stages)))
    if options.skip_failing:
        found = found.withColumns({"detector_errors": F.array_sort(errors), "detector_failures": failures})
    spans = found.withColumn("_spans", resolved(text_col, F.col("_found"), options))
    return spans.withColumn(out, tokens.numbered(F.col("_spans"), options.consistent, options.profile == "scored")).drop("_low", "_found", "_scan", "_spans", "_named")


FAILURES = "array<struct<detector:string,kind:string,message:string>>"
_SCAN = pa.struct([("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("ord", pa.int32())]))), ("failures", pa.list_(pa.struct([("detector", pa.string()), ("kind", pa.string()), ("message", pa.string())])))])


def scanned(scanners: list[tuple[int, Detector]], skip_failing: bool):
    """Struct of the spans (start, end, ord) that Python detectors find and the failures of those that raise on a text.

    Texts go to a detector in Arrow batches. Where it raises, the batch is halved until the texts that it fails on stand
    alone: its other texts, and the other detectors, keep their results.
    """

    def attempt(find: Callable, texts: list[str]) -> list:
        try:
            out = find(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} results for {len(texts)} texts")
            return [[(int(a), int(b)) for a, b in spans] for spans in out]
        except Exception as e:  # whatever a user's detector raises
            if not skip_failing:
                raise
            if len(texts) == 1:
                return [e]
            half = len(texts) // 2
            return attempt(find, texts[:half]) + attempt(find, texts[half:])

    @F.arrow_udf(f"struct<found:array<struct<start:int,end:int,ord:int>>,failures:{FAILURES}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            held = [k for k, t in enumerate(texts) if t is not None]
            out = [{"found": [], "failures": []} for _ in texts]
            for k, d in scanners:
                for at, got in zip(held, attempt(d.scan, [texts[at] for at in held]) if held else [], strict=True):
                    if isinstance(got, Exception):
                        out[at]["failures"].append({"detector": d.label, "kind": type(got).__name__, "message": (str(got).splitlines() or [""])[0]})
                    else:
                        out[at]["found"] += [{"start": a, "end": b, "ord": k} for a, b in got if a < b]
            yield pa.array(out, _SCAN)

    return of


def with_failures(df: DataFrame, *keys: str, text: str = "text", options: Options | None = None, scope: str = "query") -> tuple[DataFrame, DataFrame]:
    """(`df` redacted, failures): the second has a row (keys, detector, kind, message) for each detector that raised on a text.

    One scan writes a table that both read, so no detector runs twice and both are of the same run. A text on which a
    detector fails still has what the others find.
    """
    done = tables.keep(redact(df, text, replace(options or Options(), skip_failing=True)), scope)
    return done.drop("detector_failures", "detector_errors"), done.select(*keys, F.inline_outer("detector_failures")).filter(F.col("detector").isNotNull())


def _recognised(find: Callable, skip_failing: bool):
    """Struct of a recogniser's entities and whether it failed; texts go to it in Arrow batches, one by one after a failure."""

    @F.pandas_udf("struct<entities:array<struct<name:string,start:int,end:int>>,failed:boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            held = [t or "" for t in texts]
            try:
                found, failed = find(held), [False] * len(held)
            except Exception:
                if not skip_failing:
                    raise
                found, failed = [], []
                for t in held:
                    try:
                        found.append(find([t])[0])
                        failed.append(False)
                    except Exception:
                        found.append([])
                        failed.append(True)
            rows = [[{"name": n, "start": a, "end": b} for n, a, b in e] for e in found]
            yield pd.DataFrame({"entities": pd.Series(rows, dtype=object), "failed": failed})

    return of


def summarise(df: DataFrame, text: str = "text", entities: str = "entities") -> DataFrame:
    """Adds redacted_text, entity_count, categories_found, has_pii and token_map."""
    e = F.col(entities)
    return df.withColumns({
        "redacted_text": tokens.rewritten(F.col(text), e),
        "entity_count": F.size(e),
        "categories_found": F.array_sort(F.array_distinct(F.transform(e, lambda x: x["category"]))),
        "has_pii": F.exists(e, lambda x: x["category"].isin(*catalog.PERSONAL_CATEGORIES)),
        "token_map": tokens.token_map(e),
    })


def redact(df: DataFrame, text: str = "text", options: Options | None = None) -> DataFrame:
    """`df` with the entities of `text` and all that follows from them."""
    return summarise(detect(df, text, options), text)


def redact_columns(df: DataFrame, columns: Iterable[str] | None = None, options: Options | None = None) -> DataFrame:
    """Every string cell redacted on its own, for tables and CSV files; other columns stay as they are."""
    names = list(columns) if columns is not None else [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    out = df
    for k, name in enumerate(names):
        out = detect(out, name, options, f"_e{k}")
    return out.select(*(tokens.rewritten(F.col(f"`{c}`"), F.col(f"_e{names.index(c)}")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns))


def leaks(redacted: str = "redacted_text", entities: str = "entities") -> Column:
    """Whether a value that was found still stands in the redacted text."""
    return F.exists(F.col(entities), lambda e: F.contains(F.col(redacted), e["value"]))
