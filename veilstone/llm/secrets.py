"""Secret scans over a trigram inverted index, in DataFrame operations alone.

A Boolean trigram query is derived from each rule's parsed regex: what is written one after the other has to occur
together, alternatives give alternatives, and classes, repeats and options give nothing. Postings (trigram, document) of
the trigrams asked for are built in one scan; those of an alternative are intersected, and only candidates meet the
rule's regex. A rule that can match without any mandatory trigram scans all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm import store


#: Alternatives that a query may have; a part of a regex with more is taken as one that can match anything.
MOST_FORMS = 64
#: Stands where a match may hold anything or nothing.
GAP = "\n"


def written_forms(regex: str) -> frozenset[str]:
    """Forms of a match in lower case, with GAP where anything may stand: every match holds the runs of one form, in order."""
    c = re._constants

    def together(parts) -> frozenset[str]:
        out = {""}
        for part in parts:
            out = {x + y for x in out for y in (part if len(out) * len(part) <= MOST_FORMS else {GAP})}
        return frozenset(out)

    def forms(op, value) -> frozenset[str]:
        if op is c.LITERAL and value < 128:
            return frozenset({chr(value).lower()} - {GAP} or {GAP})
        if op is c.SUBPATTERN:
            return of(value[-1])
        if op is c.ATOMIC_GROUP:
            return of(value)
        if op is c.BRANCH:
            out = frozenset().union(*map(of, value[1]))
            return out if len(out) <= MOST_FORMS else frozenset({GAP})
        if op is c.IN and all(kind is c.LITERAL for kind, _ in value) and len(value) <= 4:
            return frozenset().union(*(forms(*x) for x in value))
        if op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            least, most, inner = value
            once = of(inner)
            if (least, most) == (0, 1):
                return once | {""}
            if not least:
                return frozenset({GAP})
            return together([once] * min(int(least), 8) + [{GAP}] * (int(least) > 8 or most != least))
        if op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            return frozenset({""})
        return frozenset({GAP})

    def of(items) -> frozenset[str]:
        return together(forms(*x) for x in items)

    return of(re._parser.parse(regex))


@dataclass(frozen=True)
class Rule:
    """A match counts if group `group` has `least` characters or more."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    base: bool = False


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
)


@lru_cache(None)
def trigram_query(rule: Rule) -> tuple[tuple[str, ...], ...]:
    """Alternatives, each the trigrams that all have to occur in lower case; empty: no trigram is mandatory. An
    alternative that asks for more than another one is left out, as the other one finds its matches too."""
    runs = [frozenset(run[i : i + 3] for run in form.split(GAP) for i in range(len(run) - 2)) for form in written_forms(rule.regex)]
    if not all(runs):
        return ()
    return tuple(sorted({tuple(sorted(x)) for x in runs if not any(y < x for y in runs)}))


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The inverted index, of the trigrams that the rules ask for: gram, doc_id; each pair once."""
    grams = sorted({g for r in rules for alternative in trigram_query(r) for g in alternative})
    held = F.filter(F.array(*(F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    low = docs.select("doc_id", F.lower("text").alias("_low"))
    # The outer form: the inner one makes the optimizer test the array's size below, which evaluates it twice.
    return low.select("doc_id", F.explode_outer(held).alias("gram")).filter("gram is not null").groupBy("gram", "doc_id").agg(F.lit(1).alias("n")).select("gram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the kinds of the rules of which the postings of one alternative all hold the document."""
    asked = [(r.kind, nth, g, len(alternative)) for r in rules for nth, alternative in enumerate(trigram_query(r)) for g in alternative]
    if not asked:
        return index.select("doc_id", F.array().cast("array<string>").alias("_kinds")).limit(0)
    query = index.sparkSession.createDataFrame(asked, "kind string, nth int, gram string, size long")  # of the rules' size
    met = index.join(F.broadcast(query), "gram").groupBy("doc_id", "kind", "nth", "size").agg(F.count("*").alias("n")).filter("n = size")
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("_kinds"))  # as many as there are rules at most


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of the rule's leftmost non-overlapping matches that are long enough; code points."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,n:int>>").alias("out"))
    pieces = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("g"), F.transform(found, lambda m: F.length(m)).alias("m"), F.transform(counted, lambda c: F.length(c)).alias("c"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        stop = begin + F.coalesce(p["m"], F.lit(0))
        span = F.struct(begin.alias("start"), stop.alias("end"), p["c"].alias("n"))
        return F.struct(stop.alias("at"), F.when(p["m"].isNotNull() & (p["c"] >= rule.least), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    all_spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))


_EMPTY = "array<struct<start:bigint,kind:string,end:bigint>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, scope: str = "query") -> DataFrame:
    """doc_id and found (array of start, kind, end, ordered by start and then by the rules' order) of every row.

    A null text counts as empty and has no spans. Rows that share an id, null included, are each scanned with their own
    text (the index holds the union of their trigrams). Other columns are ignored; an empty table gives no row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = store.keep(postings(rows, rules), scope)
    marked = rows.join(candidates(index, rules).withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    found = []
    for order, r in enumerate(rules):
        asked = F.array_contains(F.coalesce("_kinds", F.array().cast("array<string>")), r.kind) if trigram_query(r) else F.lit(True)
        some = F.when(asked & F.col("text").rlike(r.regex), spans(F.col("text"), r)).otherwise(F.array().cast(_EMPTY))
        found.append(F.transform(some, lambda s, order=order: F.struct(s["start"].alias("start"), F.lit(order).alias("nth"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return marked.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
