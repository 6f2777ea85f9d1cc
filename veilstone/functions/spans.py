"""Spans of detectors in a text column, as Catalyst expressions.

A span is (start, end, neg, ord, label, category, score, value): code points, end exclusive; neg is the negated
priority and ord the place in the registry, so that an ascending sort is the order of resolution. Regexes run only on
texts that pass a cheap necessary test.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstone.functions.registry import Detector, Registry

SPAN = "struct<start:int,neg:int,ord:int,end:int,label:string,category:string,score:double,value:string>"


def regex_spans(text: Column, regex: str | Column) -> Column:
    """Array of (start, end) of leftmost non-overlapping matches. The regex must not match the empty string."""
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(gaps.alias("g"), lengths.alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + p["m"]
        return F.struct(end.alias("at"), F.when(end.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def written(value: str | int | float) -> str:
    """A literal in SQL."""
    if not isinstance(value, str):
        return f"{value}D" if isinstance(value, float) else str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def listed(values: Iterable) -> Column:
    """A constant array, parsed at once: a call for each element would cost more than the whole plan."""
    return F.expr(f"array({', '.join(map(written, values))})")


def guard(text: str, lower: str, d: Detector) -> str:
    """What has to hold where the detector can match, in SQL over the names of the text and its lower case."""
    tests = [f"rlike({text}, {written(d.regex)})"]
    if d.need:
        tests.insert(0, f"rlike({text}, {written(d.need)})")
    if d.hints:
        tests.insert(0, "(" + " OR ".join(f"contains({lower}, {written(h)})" for h in d.hints) + ")")
    return " AND ".join(tests)


def any_of(words: Iterable[str]) -> str:
    """A regex for any of the words, shared beginnings written once, so that a text is read by one branch at most a place."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[:1], []).append(w[1:])
    done = "" in by  # what is behind a whole word does not matter
    if done:
        return ""
    parts = [re.escape(c) + any_of(rest) for c, rest in by.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def by_words(d: Detector) -> bool:
    """Whether the rule is a list of words: a regex of whole words, with many hints of letters. A match then holds one of the
    hints with no letter in front."""
    return len(d.hints) >= 7 and d.regex.removeprefix("(?i)").startswith(r"\b(") and all(re.fullmatch("[a-z]+", h) for h in d.hints)


def tests(rules: list[Detector], text: str, lower: str) -> str:
    """SQL of the numbers of the rules whose tests hold. Rules of whole words share one pass over the text: only where it finds
    any of all their hints at the beginning of a word, each is tested on its own."""
    case = lambda n: f"CASE WHEN {guard(text, lower, rules[n])} THEN {n} END"
    shared = [n for n, d in enumerate(rules) if by_words(d)]
    alone = [n for n in range(len(rules)) if n not in shared] if len(shared) > 1 else list(range(len(rules)))
    out = f"array({', '.join(map(case, alone))})"
    if len(shared) > 1:
        gate = written("(?<![a-z])" + any_of(h for n in shared for h in rules[n].hints))
        out = f"concat(cast({out} as array<int>), CASE WHEN rlike({lower}, {gate}) THEN array({', '.join(map(case, shared))}) ELSE cast(array() as array<int>) END)"
    return f"array_compact({out})"


def guard_column(text: Column, lower: Column, d: Detector) -> Column:
    """The same of a column that has no name, such as a nested value."""
    tests = text.rlike(d.regex)
    if d.need:
        tests = text.rlike(d.need) & tests
    return reduce(or_, (F.contains(lower, F.lit(h)) for h in d.hints)) & tests if d.hints else tests


@dataclass(frozen=True)
class Context:
    """How context words raise a score: by `boost`, to `floor` at least and 1 at most, where one of the detector's words is
    part of a word nearby: of the span itself, of the `before` words in front of it or of the `after` words behind it, within
    `reach` characters. With `before` None a word anywhere in the text counts."""

    boost: float = 0.35
    floor: float = 0.4
    before: int | None = 5
    after: int = 0
    reach: int = 200

    def nearby(self, lower: Column, start: Column, end: Column) -> Column:
        """The words near a span, in lower case."""
        words = lambda c, n: F.slice(F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), *n)
        begin = F.greatest(start - self.reach, F.lit(0))
        front = F.reverse(F.slice(F.reverse(F.regexp_extract_all(F.substring(lower, begin + 1, start - begin), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), 1, self.before)) if self.before else F.array().cast("array<string>")
        behind = words(F.substring(lower, end + 1, F.lit(self.reach)), (1, self.after)) if self.after else F.array().cast("array<string>")
        return F.concat(front, F.array(F.substring(lower, start + 1, end - start)), behind)

    def raised(self, score: Column, lower: Column, start: Column, end: Column, words: Column) -> Column:
        """`score`, raised where one of `words` stands nearby."""
        if self.before is None:
            held = F.exists(words, lambda w: F.contains(lower, w))
        else:
            near = F.concat_ws(" ", self.nearby(lower, start, end))
            held = F.exists(words, lambda w: F.contains(near, w))
        return F.when(held, F.least(F.lit(1.0), F.greatest(F.lit(self.floor), score + self.boost))).otherwise(score)


def spans_of(text: Column, lower: Column, registry: Registry, found: Column, context: Context | None = None) -> Column:
    """Array of SPAN, of an array of (start, end, ord): `ord` is a detector's place in the registry."""
    held = registry.detectors
    fields = {"neg": listed(-d.priority for d in held), "label": listed(d.label for d in held), "category": listed(d.category for d in held), "score": listed(float(d.score) for d in held)}
    words = F.expr("array(" + ", ".join(f"cast(array({', '.join(map(written, d.context))}) as array<string>)" for d in held) + ")") if context else None

    def span(s: Column) -> Column:
        told = {n: F.get(v, s["ord"]) for n, v in fields.items()}
        score = context.raised(told["score"], lower, s["start"], s["end"], F.get(words, s["ord"])) if context else told["score"]
        value = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["start"].cast("int").alias("start"), told["neg"].alias("neg"), s["ord"].cast("int").alias("ord"), s["end"].cast("int").alias("end"), told["label"].alias("label"), told["category"].alias("category"), score.alias("score"), value.alias("value"))

    return F.transform(found, span)


def candidates(text: str | Column, registry: Registry, lower: str | None = None, context: Context | None = None) -> Column:
    """Array of SPAN of all enabled detectors but those that scan in Python, of the column `text`, by name or, as
    for nested values, as it is (`lower` names its lower case, if there is such a column), in order of (start, priority, registry). A null text has none.

    Cheap tests tell which rules match a text at all; only these are then listed, by one expression that takes the rule's
    pattern from a constant array. So a plan holds a test for each rule, but one copy of what lists and describes spans.
    """
    quoted = lambda name: f"`{name.replace('`', '``')}`"
    body = F.col(quoted(text)) if isinstance(text, str) else text
    low = F.col(quoted(lower)) if lower else F.lower(body)
    empty = F.array().cast(f"array<{SPAN}>")
    rules = [(k, d) for k, d in enumerate(registry.detectors) if d.enabled and not d.find and not d.scan]
    own = [(k, d) for k, d in enumerate(registry.detectors) if d.enabled and d.find]
    with_ord = lambda found, k: F.transform(found, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), k.cast("int").alias("ord")))
    parts = []
    if rules:
        if isinstance(text, str):
            worth = F.expr(tests([d for _, d in rules], quoted(text), quoted(lower) if lower else f"lower({quoted(text)})"))
        else:
            worth = F.array_compact(F.array(*(F.when(guard_column(body, low, d), F.lit(n)) for n, (_, d) in enumerate(rules))))
        patterns, places = listed(d.regex for _, d in rules), listed(k for k, _ in rules)
        parts.append(F.flatten(F.transform(worth, lambda n: with_ord(regex_spans(body, F.get(patterns, n)), F.get(places, n)))))
    parts += [F.coalesce(with_ord(d.find(body), F.lit(k)), F.array().cast("array<struct<start:int,end:int,ord:int>>")) for k, d in own]
    if not parts:
        return empty
    found = F.concat(*parts) if len(parts) > 1 else parts[0]
    return F.coalesce(F.array_sort(spans_of(body, low, registry, found, context)), empty)
