"""The registered queries over the driver's tables, and their DuckDB equivalents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstone import fixtures, tables
from veilstone.functions import catalog
from veilstone.functions.registry import Detector, Registry, rule_registry, scored_registry
from veilstone.functions.spans import Context, candidates
from veilstone.oracles import ORACLES  # noqa: F401
from veilstone.operators import cache, metrics, overlap, ranges, resolve, sketches, tokens, trees, views
from veilstone.operators.numbering import TokenTable
from veilstone.operators.redact import Options, detect, leaks, redact, redact_columns, with_failures
from veilstone.plans.samples import chain, from_conversations, redact_samples, reviewer_samples
from veilstone.sources.files import parse_lines

#: Rules that both regex engines read alike: their results can be compared value by value.
SAFE = ("EMAIL", "PHONE_INTL", "BANK_ACCOUNT", "MAC_ADDRESS", "DRIVERS_LICENSE", "CRYPTO_ADDRESS", "URL_WITH_CREDENTIALS", "DOMAIN")
#: Rules that hit common prose.
NOISY = ("SWIFT_BIC", "PERSON_FULL")
#: Rules with lookarounds, in the form that decides only whether a text has a match.
EXISTS = {
    "PHONE": r"(^|[^0-9])(\+?1[-.\s]?)?(\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}($|[^0-9])",
    "CREDIT_CARD": r"(^|[^0-9])(4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(011|5\d{2}))([-\s]?\d{4}){2,3}($|[^0-9])",
    "IP_ADDRESS": r"(^|[^0-9])((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)($|[^0-9])",
    "ZIP_CODE": r"(^|[^0-9])\d{5}(-\d{4})?($|[^0-9])",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt over the cores where it is so small that a core's share would not fill a split; larger ones are read as
    they lie."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(table._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return table if size >= cores * split else table.repartition(cores)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _safe(profile: str = "rule") -> Options:
    return Options(profile=profile, registry=rule_registry().only(SAFE))


def email_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact(_documents(spark, sf_dir), options=Options(labels=("EMAIL",)))
    return out.select("doc_id", "redacted_text", F.col("entity_count").cast("long").alias("entity_count"))


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(_documents(spark, sf_dir), options=Options(labels=("EMAIL",)))
    return resolve.exploded(out, "entities", "doc_id").select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "value", "token")


def safe_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact(_documents(spark, sf_dir), options=_safe())
    return out.select("doc_id", "redacted_text", F.col("entity_count").cast("long").alias("entity_count"), F.array_join("categories_found", ",").alias("categories"))


def safe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(_documents(spark, sf_dir), options=_safe())
    return resolve.exploded(out, "entities", "doc_id").select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "label", "category", "value", "token")


def safe_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(_documents(spark, sf_dir), options=_safe())
    return metrics.entity_counts(resolve.exploded(out, "entities", "doc_id"))


def safe_scored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored sweep over the safe rules: no replacement, values share tokens."""
    out = detect(_documents(spark, sf_dir), options=_safe("scored"))
    return resolve.exploded(out, "entities", "doc_id").select("doc_id", F.col("start").cast("long").alias("start_at"), "label", "value")


def safe_tokens_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering without consistency: every entity the next number of its label."""
    o = _safe()
    out = detect(_documents(spark, sf_dir), options=Options(registry=o.registry, consistent=False))
    return resolve.exploded(out, "entities", "doc_id").select("doc_id", F.col("start").cast("long").alias("start_at"), "token")


def safe_corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve.exploded(detect(_documents(spark, sf_dir), options=_safe()), "entities", "doc_id")
    return tokens.corpus_tokens(out, ["doc_id", "start"]).select("label", "value", "token")


def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deny-list wins over an allow-list, and what it excludes shadows nothing."""
    o = Options(registry=rule_registry().only(SAFE), categories=("PII", "NETWORK"), skip_categories=("PII",))
    return redact(_documents(spark, sf_dir), options=o).select("doc_id", "redacted_text")


def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules but some; what is left out shadows nothing."""
    out = redact(_documents(spark, sf_dir), options=Options(skip_labels=NOISY))
    return out.select("doc_id", "redacted_text", F.col("entity_count").cast("long").alias("entity_count"), "has_pii")


def scored_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored profile under one threshold, without overrides."""
    return _flat(views.full(redact(_documents(spark, sf_dir), options=Options("scored", threshold=0.7, overrides={})), "doc_id", with_score=True))


def token_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and value of each document's entities."""
    return redact(_documents(spark, sf_dir)).select("doc_id", F.explode_outer("token_map").alias("token", "value")).filter("token is not null")


def restored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted texts with the values of their tokens put back."""
    out = redact(_documents(spark, sf_dir))
    return out.select("doc_id", tokens.restored(F.col("redacted_text"), F.col("token_map")).alias("text"))


def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found, by category."""
    found = resolve.exploded(detect(_documents(spark, sf_dir)), "entities", "doc_id")
    return metrics.labels_by_category(found).withColumn("labels", F.array_join("labels", ","))


def chained_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages, and a third rule where neither found anything."""
    of = lambda k: rule_registry().only([k])
    out = chain(_documents(spark, sf_dir), stages=[of("EMAIL"), of("IP_ADDRESS")], fallback=of("PERSON_FULL"))
    return out.select("doc_id", "redacted_text", F.array_join(F.transform("stage_counts", lambda n: n.cast("string")), ",").alias("counts"))


def _labelled(label: str):
    return lambda s: s["label"] == label


def docs_with_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates("text", rule_registry().only(EXISTS))
    flags = [F.exists("f", _labelled(k)).alias(f"has_{k.lower()}") for k in EXISTS]
    return _documents(spark, sf_dir).select("doc_id", found.alias("f")).select("doc_id", *flags)


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches before overlaps are resolved, by rule."""
    found = candidates("text", rule_registry().only(SAFE))
    spans = resolve.exploded(_documents(spark, sf_dir).withColumn("f", found), "f", "doc_id")
    return spans.groupBy("label").agg(F.count("*").alias("n"))


def _flat(view: DataFrame) -> DataFrame:
    """A view whose arrays are written out, so that it compares value by value."""
    fields = ("label", "category", "token", "start", "end", *(["score"] if "score" in view.schema.simpleString() else []))
    entities = [F.array_join(F.transform("entities", lambda e: F.concat_ws(":", *(e[f].cast("string") for f in fields))), ",").alias("entities")] if "entities" in view.columns else []
    return view.select("doc_id", "redacted_text", F.col("entity_count").cast("long").alias("entity_count"), F.array_join("categories_found", ",").alias("categories"), *entities)


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 44 rules, full view, its entities written out."""
    return _flat(views.full(redact(_documents(spark, sf_dir)), "doc_id"))


def redact_documents_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored profile, full view with scores, its entities written out."""
    return _flat(views.full(redact(_documents(spark, sf_dir), options=Options("scored")), "doc_id", with_score=True))


def redact_documents_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping entities become one; reviewer's view."""
    return _flat(views.reviewer(redact(_documents(spark, sf_dir), options=Options(strict=True)), "doc_id"))


def _with_fixtures(spark: SparkSession, sf_dir: str, texts) -> DataFrame:
    """Every document with a fixture text in front: text number doc_id modulo their count."""
    held = F.array(*(F.lit(fixtures.unmarked(t)[0]) for t in texts))
    front = F.get(held, F.pmod("doc_id", F.lit(len(texts))).cast("int"))
    return _documents(spark, sf_dir).withColumn("text", F.concat_ws(fixtures.BREAK, front, "text"))


def _fronts(redacted: DataFrame) -> DataFrame:
    return redacted.select("doc_id", F.substring_index("redacted_text", fixtures.BREAK, 1).alias("front"), F.length("redacted_text").cast("long").alias("n_chars"))


def golden_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with texts of each rule in front: what becomes of these."""
    return _fronts(redact(_with_fixtures(spark, sf_dir, fixtures.RULE_TEXTS)))


def golden_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with texts of each scored entity."""
    return _fronts(redact(_with_fixtures(spark, sf_dir, fixtures.SCORED_TEXTS), options=Options("scored")))


def golden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities found in the documents and the texts in front of them, by label."""
    found = resolve.exploded(detect(_with_fixtures(spark, sf_dir, fixtures.RULE_TEXTS)), "entities", "doc_id")
    return metrics.entity_counts(found)


def leak_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a value that was found still stands."""
    return metrics.share(redact(_documents(spark, sf_dir)), leaks(), "leak_rate")


def redact_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are redacted once."""
    work = lambda d: redact(d).select("cache_key", "text", "redacted_text")
    return cache.once_each(_documents(spark, sf_dir), "text", work).select("doc_id", "redacted_text")


def dedupe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.dedupe_stats(_documents(spark, sf_dir))


def text_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_documents(spark, sf_dir), F.length("text"), catalog.LENGTH_BUCKETS)


def sample_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = from_conversations(_table(spark, sf_dir, "conversations"))
    out = redact_samples(samples)
    return out.select("sample_id", "redacted_prompt", "redacted_response", F.col("total_entities").cast("long").alias("total_entities"))


def sample_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewer_samples(redact_samples(from_conversations(_table(spark, sf_dir, "conversations"))))


def chained_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [Registry(rule_registry().only([k]).detectors) for k in ("EMAIL", "DRIVERS_LICENSE", "DOMAIN")]
    out = chain(_documents(spark, sf_dir), stages=stages)
    return out.select("doc_id", "redacted_text", F.array_join(F.transform("stage_counts", lambda n: n.cast("string")), ",").alias("counts"))


def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.validated(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), longest=20_000, language="lang")
    return out.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def redact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string cell of a table on its own."""
    return redact_columns(_table(spark, sf_dir, "documents"))


def lines_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON and plain text: of the events, one kind as JSON, the rest as their bare property text."""
    events = _table(spark, sf_dir, "events")
    json = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("props").alias("response")))
    lines = events.select(F.when(F.col("event_type") == "view", json).when(F.col("event_type") == "click", F.lit("  ")).otherwise(F.concat(F.lit("raw "), "event_type")).alias("value"), F.col("event_id").alias("line_no"))
    return parse_lines(lines)


def _hits_by_category(spark: SparkSession, found: DataFrame, registry: Registry) -> DataFrame:
    """Each category's detectors beside what they find."""
    hits = found.groupBy("label").agg(F.count("*").alias("hits"))
    held = registry.to_df(spark).join(hits, "label", "left")
    return held.groupBy("category").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("detectors"), F.max("priority").cast("long").alias("top_priority"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def registry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the rules before overlaps are resolved, and the registry itself, by category."""
    found = _with_fixtures(spark, sf_dir, fixtures.RULE_TEXTS).select(F.inline_outer(candidates("text", rule_registry()))).filter("label is not null")
    return _hits_by_category(spark, found, rule_registry())


def registry_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels and categories of the scored entities found."""
    found = resolve.exploded(detect(_with_fixtures(spark, sf_dir, fixtures.SCORED_TEXTS), options=Options("scored")), "entities", "doc_id")
    return found.groupBy("category", "label").agg(F.count("*").alias("hits")).groupBy("category").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


def years(texts: list[str]) -> list[list[tuple[int, int]]]:
    """A detector of one's own, which fails on some texts."""
    if any("###" in t for t in texts):
        raise ValueError("cannot read ###")
    return [[m.span() for m in re.finditer(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", t)] for t in texts]


def words_of_shame(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Another one, which fails on others."""
    out = []
    for t in texts:
        if len(t) % 11 == 0:
            raise ArithmeticError(f"{len(t)} characters")
        out.append([m.span() for m in re.finditer(r"\*\*\*|%%%", t)])
    return out


def _own_detectors() -> Options:
    own = (Detector("YEAR", "CUSTOM", scan=years, priority=5), Detector("SHAME", "CUSTOM", scan=words_of_shame, priority=4))
    return Options(registry=Registry((*rule_registry().only(("EMAIL", "DRIVERS_LICENSE")).detectors, *own)))


def redact_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whatever detectors failed on them."""
    done, _ = with_failures(_documents(spark, sf_dir), "doc_id", options=_own_detectors())
    return done.select("doc_id", "redacted_text", F.col("entity_count").cast("long").alias("entity_count"))


def detector_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each detector that raised on a document."""
    return with_failures(_documents(spark, sf_dir), "doc_id", options=_own_detectors())[1]


def failures_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.failures_by_kind(detector_failures(spark, sf_dir))


def incremental_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the documents numbered in turn, the second one twice, and the table made one: the numbers of one run."""
    found = resolve.exploded(detect(_documents(spark, sf_dir), options=_safe()), "entities", "doc_id")
    middle = _documents(spark, sf_dir).agg(F.floor(F.avg("doc_id"))).first()[0] or 0
    table = TokenTable(spark, tables.working_folder(spark, "tokens"))
    table.add(found.filter(F.col("doc_id") <= middle), ["doc_id", "start"], 0)
    for _ in range(2):
        table.add(found.filter(F.col("doc_id") > middle), ["doc_id", "start"], 1)
    table.compact()
    return table.state()


def context_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of an address behind `wallet` and up to eight words, and in front of each document."""
    front = F.concat(F.lit("wallet "), F.repeat(F.lit("so "), F.pmod("doc_id", F.lit(9)).cast("int")), F.lit("0x52908400098527886e0f7030069857d2e4169ee7 and then "))
    docs = _documents(spark, sf_dir).withColumn("text", F.concat(front, F.col("text")))
    options = Options("scored", registry=scored_registry().only(("CRYPTO", "SWIFT_BIC", "MEDICATION")), context=Context(0.05, 0.4, 5))
    found = resolve.exploded(detect(docs, options=options), "entities", "doc_id")
    return found.select("doc_id", F.col("start").cast("long").alias("start_at"), "label", F.round("score", 6).alias("score"))


#: What is held against what: domains against the mails and links that hold them, names against longer names.
_INNER, _OUTER = ("DOMAIN", "PERSON_FULL", "PHONE"), ("EMAIL", "URL_WITH_CREDENTIALS", "PERSON", "PHONE_INTL")


def _rows_of(docs: DataFrame, labels) -> DataFrame:
    return docs.select("doc_id", F.inline_outer(candidates("text", rule_registry().only(labels)))).filter("label is not null").select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "label")


def spans_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one registry that overlap none of another's, as rows."""
    docs = _with_fixtures(spark, sf_dir, fixtures.RULE_TEXTS)
    return overlap.without_overlap(_rows_of(docs, _INNER), _rows_of(docs, _OUTER), "doc_id", "start_at", "end_at")


def spans_not_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which another registry has no equal one."""
    docs = _with_fixtures(spark, sf_dir, fixtures.RULE_TEXTS)
    return overlap.not_repeated(_rows_of(docs, ("PHONE", "ZIP_CODE", "DATE", "MEDICAL_CONDITION")), _rows_of(docs, ("PHONE_INTL", "CREDIT_CARD", "ZIP_CODE", "SSN")), "doc_id", "start_at", "end_at")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def event_rate_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate(_events(spark, sf_dir), "ts", "1 minute", 60, "event_type")


def event_error_ratio_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratio(_events(spark, sf_dir), "ts", "5 minutes", F.col("event_type") == "error")


def event_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantiles(_events(spark, sf_dir), "value", (0.5, 0.95, 0.99), "event_type")


def event_top_users_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_k(_events(spark, sf_dir), "ts", "1 hour", "user_id", 10).withColumn("rank", F.col("rank").cast("long"))


def event_heavy_users_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bounded states of each hour, their keys counted exactly."""
    return sketches.heavy_hitters(_events(spark, sf_dir), "ts", "1 hour", "user_id", 10).withColumn("rank", F.col("rank").cast("long"))


def event_sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a day from states of a minute, and whether their exact ranks lie within the stated error."""
    events, qs = _events(spark, sf_dir), (0.5, 0.95, 0.99)
    day = F.date_trunc("day", "window_start").alias("day")
    told = sketches.estimated(sketches.merged(sketches.quantile_states(events, "ts", "value", "1 minute", "event_type"), day, "event_type"), qs)
    both = events.withColumn("day", F.date_trunc("day", "ts")).join(told.drop("state", "n"), ["day", "event_type"])
    out = []
    for q in qs:
        below, upto = (F.count_if(f(F.col("value"), F.col(f"p{round(q * 100)}"))) / F.count("value") for f in (lambda v, p: v < p, lambda v, p: v <= p))
        out.append(((below <= q + 2 * sketches.rank_error()) & (upto >= q - 2 * sketches.rank_error())).alias(f"p{round(q * 100)}_within"))
    return both.groupBy("day", "event_type").agg(F.count("value").alias("n"), *out)


def event_sliding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second of every five minutes, each minute, by type."""
    return ranges.sliding_rate(_events(spark, sf_dir), "ts", 300, 60, "event_type")


def event_sliding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of errors of every five minutes, each minute."""
    return ranges.sliding_rate(_events(spark, sf_dir), "ts", 300, 60, condition=F.col("event_type") == "error")


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values, in hundredths, read as a counter that begins anew where it falls."""
    return _events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))


def _increases(df: DataFrame) -> DataFrame:
    return df.select("window_start", *(c for c in ("event_type", "rank") if c in df.columns), "n", "raw", F.round("increase", 4).alias("increase"), F.round("rate", 6).alias("rate"))


def event_counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of the counter over every five minutes, each minute: all events as one series."""
    return _increases(ranges.increase(_counter(spark, sf_dir), "ts", "c", 300, 60))


def event_top_increase_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three types whose counters grew most in every hour, each five minutes."""
    grown = ranges.increase(_counter(spark, sf_dir), "ts", "c", 3600, 300, "event_type")
    return _increases(ranges.top_increase(grown, 3, "event_type")).withColumn("rank", F.col("rank").cast("long"))


def redact_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of differing shape and type: each event's properties in a list, an object or a bare value."""
    props = F.col("props")
    mail = F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('@mail.example.org and \\"more\\""'))
    shapes = [F.concat(F.lit('{"user": '), mail, F.lit(', "mail@x.org": 1.50, "deep": [{"p": '), props, F.lit('}, null, "10.0.0.1"]}')), F.concat(F.lit("["), mail, F.lit(", true, "), props, F.lit("]")), mail, props, F.concat(F.lit("not JSON: a@b.org "), props)]
    tree = F.get(F.array(*shapes), F.pmod("event_id", F.lit(len(shapes))).cast("int"))
    out = trees.redact_json(_events(spark, sf_dir).select("event_id", tree.alias("tree")), "event_id", "tree", Options(labels=("EMAIL", "IP_ADDRESS")))
    return out


def event_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_events(spark, sf_dir), F.col("value") / 100, catalog.LATENCY_BUCKETS, "event_type")


def event_batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("size"))
    return metrics.histogram(sizes, "size", catalog.BATCH_BUCKETS)


def event_bucket_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bucket_quantile(event_latency_histogram(spark, sf_dir), 0.5, "event_type")


def event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"))
    return metrics.pipeline_stats(rows)


def event_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return cache.breaker(rows, "user_id", "ts", "ok", threshold=2, recovery_seconds=3600)


def event_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("k"), "ts")
    return cache.expiring_hits(rows, "k", "ts", 300).groupBy("k").agg(F.count_if("hit").alias("hits"), F.count("*").alias("total"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests: an error is a status of 500."""
    return _events(spark, sf_dir).withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.request_counts(_requests(spark, sf_dir), "event_type").withColumn("status", F.col("status").cast("long"))


def event_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauges(_events(spark, sf_dir), "event_type", "ts", "value")


def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput, latency and error rate of a day against the targets."""
    rows = _requests(spark, sf_dir).select((F.col("status") < 500).alias("ok"), F.col("value").alias("ms"))
    return metrics.service_level(rows, 86_400)


def label_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of high quality, taken to hold nothing personal, in which something is found."""
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    cases = detect(_documents(spark, sf_dir).join(clean, "doc_id")).withColumn("expected", F.array().cast("array<string>"))
    return metrics.false_positives(cases)


def detection_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with an entity, by label of quality."""
    found = detect(_documents(spark, sf_dir)).select("doc_id", (F.size("entities") > 0).alias("found"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return found.join(labels, "doc_id").groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("total"), F.count_if("found").alias("detected"))


def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sampled(_documents(spark, sf_dir), "doc_id", 5).select("doc_id", views.shortened(F.col("text")).alias("head"))


_QUERIES = (email_redact, email_spans, safe_redact, safe_entities, safe_entity_counts, safe_scored_entities, safe_tokens_each, safe_corpus_tokens, category_filter, docs_with_label, candidate_counts, redact_documents, redact_documents_scored, redact_documents_strict, leak_rate, redact_once_each, dedupe_stats, text_length_histogram, golden_rules, golden_scored, golden_labels, label_filter, scored_threshold, token_maps, restored_documents, entity_labels, chained_fallback, sample_redact, sample_reviewer, chained_redact, validation_status, redact_cells, lines_parsed, registry_rules, registry_scored, redact_with_failures, detector_failures, failures_by_kind, incremental_tokens, context_near, spans_without_overlap, spans_not_repeated, redact_event_props, event_rate_1m, event_error_ratio_5m, event_quantiles, event_top_users_1h, event_heavy_users_1h, event_sketch_quantiles, event_sliding_rate, event_sliding_errors, event_counter_increase, event_top_increase_1h, event_latency_histogram, event_batch_histogram, event_bucket_quantile, event_stats, event_requests, event_gauges, event_targets, label_false_positives, event_breaker, event_cache_hits, detection_vs_labels, qa_sample)
QUERIES = {f.__name__: f for f in _QUERIES}
