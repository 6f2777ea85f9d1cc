"""Registries of detectors: immutable, pruned when a plan is built, so what is switched off never enters the plan."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone.functions import catalog


_LOG = logging.getLogger("veilstone")


@dataclass(frozen=True)
class Detector:
    """One rule. `regex` is Java's dialect; `find`, instead, maps a text column to an array of (start, end); `scan`, instead,
    is a Python function that gives a list of (start, end), in code points, for each of a list of texts."""

    label: str
    category: str
    regex: str = ""
    priority: int = 5
    score: float = 1.0
    hints: tuple[str, ...] = ()
    need: str = ""
    context: tuple[str, ...] = ()
    description: str = ""
    enabled: bool = True
    find: Callable[[Column], Column] | None = None
    scan: Callable[[list[str]], list[list[tuple[int, int]]]] | None = None


class Registry:
    def __init__(self, detectors: Iterable[Detector]):
        self.detectors = tuple(detectors)

    def __len__(self) -> int:
        return len(self.detectors)

    def labels(self) -> list[str]:
        return list(dict.fromkeys(d.label for d in self.detectors))

    def categories(self) -> list[str]:
        """Distinct categories, those of disabled detectors included."""
        return sorted({d.category for d in self.detectors})

    def enabled(self) -> list[Detector]:
        return [d for d in self.detectors if d.enabled]

    def by_category(self, category: str) -> list[Detector]:
        return [d for d in self.enabled() if d.category == category]

    def with_detector(self, detector: Detector) -> Registry:
        return Registry((*self.detectors, detector))

    def only(self, labels: Iterable[str]) -> Registry:
        wanted = self._known(labels)
        return Registry(d for d in self.detectors if d.label in wanted)

    def enable(self, *labels: str) -> Registry:
        return self._switch(labels, True)

    def disable(self, *labels: str) -> Registry:
        return self._switch(labels, False)

    def _known(self, labels: Iterable[str]) -> set[str]:
        wanted = set(labels)
        if unknown := wanted - set(self.labels()):
            raise KeyError(f"no such label: {', '.join(sorted(unknown))}")
        return wanted

    def _switch(self, labels: Iterable[str], on: bool) -> Registry:
        wanted = self._known(labels)
        return Registry(replace(d, enabled=on) if d.label in wanted else d for d in self.detectors)

    def prune(self, categories: Iterable[str] | None = None, skip_categories: Iterable[str] | None = None, labels: Iterable[str] | None = None, skip_labels: Iterable[str] | None = None) -> Registry:
        """What is enabled and allowed. An empty allow-list allows all; a deny-list wins over it."""
        allow, deny = set(categories or ()), set(skip_categories or ())
        allow_labels, deny_labels = set(labels or ()), set(skip_labels or ())
        return Registry(d for d in self.enabled() if (not allow or d.category in allow) and d.category not in deny and (not allow_labels or d.label in allow_labels) and d.label not in deny_labels)

    def checked(self, spark: SparkSession) -> tuple[Registry, dict[str, str]]:
        """The detectors that can be evaluated, and the error of each label's that cannot: a regex that does not compile or
        can match the empty string somewhere, a `find` that fails or gives something else than (start, end)."""
        kept, errors = [], {}
        for d in self.detectors:
            try:
                if d.find:
                    made = spark.range(1).select(d.find(F.lit("x 1")).alias("s"))
                    made.select(F.transform("s", lambda s: s["start"] + s["end"])).collect()
                elif not d.scan:
                    spark._jvm.java.util.regex.Pattern.compile(d.regex)
                    if least_width(d.regex) == 0 or any(_matches_empty(spark, d.regex, t) for t in ("", "a", "1 a", "\n")):
                        raise ValueError("the regex can match the empty string")
                kept.append(d)
            except Exception as e:  # whatever a user's detector raises
                errors[d.label] = str(getattr(e, "java_exception", e)).splitlines()[0]
                _LOG.warning("detector %s is skipped: %s", d.label, errors[d.label])
        return Registry(kept), errors

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, d.label, d.category, d.priority, d.score, d.regex, d.description, d.enabled) for k, d in enumerate(self.detectors)]
        return spark.createDataFrame(rows, "ord int, label string, category string, priority int, score double, regex string, description string, enabled boolean")


def least_width(regex: str) -> int | None:
    """The length of the shortest match, by the parsed regex; None where Python does not read Java's dialect."""
    try:
        return re._parser.parse(regex).getwidth()[0]
    except (re.error, OverflowError):
        return None


def _matches_empty(spark: SparkSession, regex: str, text: str) -> bool:
    matcher = spark._jvm.java.util.regex.Pattern.compile(regex).matcher(text)
    while matcher.find():
        if matcher.start() == matcher.end():
            return True
    return False


def _regex(pattern: str, flags: str) -> str:
    return ("(?i)" if "i" in flags else "") + pattern


def rule_registry() -> Registry:
    """The rule profile: priorities decide between overlapping spans."""
    return Registry(Detector(label, category, _regex(pattern, flags), priority, 1.0, hints, need, description=label.replace("_", " ").lower()) for label, category, priority, flags, pattern, hints, need in catalog.RULES)


def scored_registry() -> Registry:
    """The scored profile: scores and thresholds decide. Entities named after a rule take its pattern."""
    rules = {d.label: d for d in rule_registry().detectors}

    def detector(label: str, category: str, score: float, pattern: str, flags: str = "", context: tuple[str, ...] = ()) -> Detector:
        if pattern.startswith("="):
            rule = rules[pattern[1:]]
            return Detector(label, category, rule.regex, 0, score, rule.hints, rule.need, context)
        return Detector(label, category, _regex(pattern, flags), 0, score, context=context)

    return Registry([*(detector(*row) for row in catalog.SCORED), *(detector(*row) for row in catalog.GENERAL)])


def chained_registry() -> Registry:
    """The order and product numbers of the chained profile."""
    return Registry(Detector(label, "CUSTOM", pattern, hints=(re.match("[A-Z]+-", pattern)[0].lower(),)) for label, pattern in catalog.CHAINED)
