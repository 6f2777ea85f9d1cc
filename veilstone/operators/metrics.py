"""Counts, rates, histograms and quantiles over results and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone.operators.tokens import ranged_number

#: Different values, over all groups, up to which quantiles are taken by one aggregate.
FEW_VALUES = 1 << 18


def entity_counts(entities: DataFrame) -> DataFrame:
    """label, category, n of exploded entities."""
    return entities.groupBy("label", "category").agg(F.count("*").alias("n"))


def labels_by_category(entities: DataFrame) -> DataFrame:
    return entities.groupBy("category").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.count("*").alias("n"))


def pipeline_stats(results: DataFrame, ok: str = "ok", ms: str = "ms") -> DataFrame:
    """processed (successes), errors, avg_ms (2 places, 0 if none), error_rate (4 places), in one row."""
    done, failed = F.count_if(F.col(ok)), F.count_if(~F.col(ok))
    return results.agg(done.alias("processed"), failed.alias("errors"), F.coalesce(F.round(F.avg(F.when(F.col(ok), F.col(ms))), 2), F.lit(0.0)).alias("avg_ms"), F.round(failed / F.greatest(done, F.lit(1)), 4).alias("error_rate"))


def histogram(df: DataFrame, value: str | Column, buckets: tuple[float, ...], *by: str) -> DataFrame:
    """le and n, cumulative, with le null for all values; a row for each bucket (and group)."""
    v = F.col(value) if isinstance(value, str) else value
    counts = df.groupBy(*by).agg(*(F.count_if(v <= b).alias(f"_b{k}") for k, b in enumerate(buckets)), F.count(v).alias("_all"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("n")) for k, b in enumerate(buckets)), F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return counts.select(*by, F.inline(rows))


def bucket_quantile(hist: DataFrame, q: float, *by: str) -> DataFrame:
    """The quantile of a cumulative histogram, interpolated within its bucket; the last bound for what lies above it."""
    rows = hist.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), "n"))).alias("h"))  # one row a bucket
    rank = F.element_at("h", -1)["n"] * q
    k = F.size(F.filter("h", lambda x: x["n"] < rank))
    at = F.element_at("h", F.least(k + 1, F.size("h")))
    low = F.when(k > 0, F.element_at("h", F.greatest(k, F.lit(1)))["le"]).otherwise(F.lit(0.0))
    below = F.when(k > 0, F.element_at("h", F.greatest(k, F.lit(1)))["n"]).otherwise(F.lit(0))
    inside = low + (at["le"] - low) * (rank - below) / F.greatest(at["n"] - below, F.lit(1))
    return rows.select(*by, F.when(at["le"] == float("inf"), low).otherwise(inside).alias("value"))


def rate(events: DataFrame, ts: str, width: str, seconds: int, *by: str) -> DataFrame:
    """Events a second of each tumbling window: window_start, rate."""
    return events.groupBy(F.window(ts, width).alias("_w"), *by).agg((F.count("*") / seconds).alias("rate")).select(F.col("_w.start").alias("window_start"), *by, "rate")


def ratio(events: DataFrame, ts: str, width: str, condition: Column) -> DataFrame:
    """Share of events that meet the condition, by window."""
    return events.groupBy(F.window(ts, width).alias("_w")).agg((F.count_if(condition) / F.count("*")).alias("ratio")).select(F.col("_w.start").alias("window_start"), "ratio")


def quantiles(events: DataFrame, value: str, qs: tuple[float, ...], *by: str) -> DataFrame:
    """Exact quantiles p50, p95, ... by group, interpolated between neighbours; nulls don't count, a group without values has
    null quantiles. Equal values are counted first. Up to FEW_VALUES of them, over all groups, are summed up group by group;
    more are summed up range by range, so no group meets in one task."""
    groups = events.groupBy(*by).agg(F.count(value).alias("_total")).withColumn("_g", F.struct(*by) if by else F.struct(F.lit(0)))
    held = events.filter(F.col(value).isNotNull()).select((F.struct(*by) if by else F.struct(F.lit(0))).alias("_g"), F.col(value).alias("_v"))
    counted = held.groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    if counted.limit(FEW_VALUES + 1).count() <= FEW_VALUES:
        upto = counted.withColumn("number", F.sum("_c").over(Window.partitionBy("_g").orderBy("_v")))
    else:
        upto = ranged_number(counted, "_g", "_v", "_c")
    placed = upto.join(groups.select("_g", "_total"), "_g")
    found = []
    for k, q in enumerate(qs):
        at = (F.col("_total") - 1) * F.lit(float(q))
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):  # places from 0
            found.append(F.max(F.when((F.col("number") > place) & (F.col("number") - F.col("_c") <= place), F.col("_v"))).alias(f"_{name}{k}"))
    ends = placed.groupBy("_g").agg(*found)
    out = []
    for k, q in enumerate(qs):
        at = (F.col("_total") - 1) * F.lit(float(q))
        out.append((F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (at - F.floor(at))).alias(f"p{round(q * 100)}"))
    return groups.join(ends, "_g", "left").select(*by, *out)


def top_k(events: DataFrame, ts: str, width: str, key: str, k: int) -> DataFrame:
    """The k most frequent keys of each window; ties by key."""
    counts = events.groupBy(F.window(ts, width).alias("_w"), key).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("_w").orderBy(F.desc("n"), key))
    return counts.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("_w.start").alias("window_start"), key, "n", "rank")


def detection_rate(cases: DataFrame, detected: str = "detected", text: str = "text", misses: int = 5) -> DataFrame:
    """total, rate and the first misses (by text)."""
    totals = cases.agg(F.count("*").alias("total"), F.avg(F.col(detected).cast("double")).alias("rate"), F.lit(None).cast("string").alias("_t"))
    missed = cases.filter(~F.col(detected)).select(F.col(text).alias("_t")).distinct().orderBy("_t").limit(misses)
    rows = totals.union(missed.select(F.lit(None).cast("long"), F.lit(None).cast("double"), "_t"))  # 1 + misses rows
    return rows.agg(F.max("total").alias("total"), F.max("rate").alias("rate"), F.array_sort(F.collect_list("_t")).alias("misses"))


def false_positives(cases: DataFrame, entities: str = "entities", expected: str = "expected") -> DataFrame:
    """total, false_positives and false_positive_rate: of texts in which nothing is expected (an empty or null list of
    labels), those in which something is found."""
    clean = cases.filter(F.coalesce(F.size(F.col(expected)), F.lit(0)) <= 0)
    hit = F.coalesce(F.size(F.col(entities)), F.lit(0)) > 0
    return clean.agg(F.count("*").alias("total"), F.count_if(hit).alias("false_positives"), F.avg(hit.cast("double")).alias("false_positive_rate"))


def request_counts(requests: DataFrame, endpoint: str = "endpoint", status: str = "status") -> DataFrame:
    """requests and errors (status of 500 or more, or null) by endpoint and status."""
    failed = F.col(status).isNull() | (F.col(status) >= 500)
    return requests.groupBy(endpoint, status).agg(F.count("*").alias("requests"), F.count_if(failed).alias("errors"))


def failures_by_kind(failures: DataFrame) -> DataFrame:
    """detector, kind of error and n of detectors' failures."""
    return failures.groupBy("detector", "kind").agg(F.count("*").alias("n"))


def gauges(samples: DataFrame, name: str = "name", ts: str = "ts", value: str = "value") -> DataFrame:
    """The latest value of each gauge; the largest of those at one time."""
    return samples.groupBy(name).agg(F.max(F.struct(ts, value)).alias("_l")).select(name, F.col(f"_l.{ts}").alias(ts), F.col(f"_l.{value}").alias(value))


def service_level(requests: DataFrame, seconds: float, ok: str = "ok", ms: str = "ms", p50: float = 50, p99: float = 500, per_second: float = 500, error_rate: float = 0.001) -> DataFrame:
    """throughput over `seconds`, p50, p99 and error_rate of requests, and whether all targets are met, in one row."""
    done = requests.agg(F.count("*").alias("n"), F.count_if(~F.col(ok)).alias("bad")).withColumn("_k", F.lit(0))
    both = quantiles(requests, ms, (0.5, 0.99)).withColumn("_k", F.lit(0)).join(done, "_k")
    row = both.select((F.col("n") / seconds).alias("throughput"), "p50", "p99", (F.col("bad") / F.greatest("n", F.lit(1))).alias("error_rate"))
    met = (F.col("throughput") > per_second) & (F.col("p50") < p50) & (F.col("p99") < p99) & (F.col("error_rate") < error_rate)
    return row.withColumn("met", F.coalesce(met, F.lit(False)))


def share(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.avg(condition.cast("double")).alias(name))
