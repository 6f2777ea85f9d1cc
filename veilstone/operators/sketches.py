"""Mergeable states of bounded size: quantiles by KLL sketches, heavy hitters by frequent-items sketches.

States are made once for each window and merged to any range of windows; they can be written and merged later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstone import tables

#: Accuracy of the quantile states: about 13 kB each at most. Items that a frequent-items state tracks.
K, TRACKED = 800, 4096


def rank_error(k: int = K) -> float:
    """The rank error, as a share of the values, that a quantile state stays under with 99 % probability (published fit)."""
    return 2.296 / k**0.9021


def quantile_states(events: DataFrame, ts: str, value: str, width: str, *by: str, k: int = K) -> DataFrame:
    """window_start, the groups, n and a quantile state for each window; null and NaN values don't count."""
    v = F.col(value).cast("double")
    held = events.filter(v.isNotNull() & ~F.isnan(v))
    return held.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("state")).select(F.col("_w.start").alias("window_start"), *by, "n", "state")


def merged(states: DataFrame, *by: str | Column) -> DataFrame:
    """One state for each group of states: of a longer range, of fewer keys, of everything."""
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("state").alias("state"))


def estimated(states: DataFrame, qs: tuple[float, ...]) -> DataFrame:
    """Adds p50, p95, ... of each state."""
    return states.withColumns({f"p{round(q * 100)}": F.kll_sketch_get_quantile_double("state", F.lit(float(q))) for q in qs})


def frequent_states(events: DataFrame, ts: str, width: str, key: str, tracked: int = TRACKED) -> DataFrame:
    """window_start, n and a frequent-items state of each window; null keys don't count."""
    held = events.filter(F.col(key).isNotNull())
    return held.groupBy(F.window(ts, width).alias("_w")).agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(`{key}`, {int(tracked)})").alias("state")).select(F.col("_w.start").alias("window_start"), "n", "state")


def merged_frequent(states: DataFrame, *by: str | Column) -> DataFrame:
    return states.groupBy(*by).agg(F.sum("n").alias("n"), F.expr("approx_top_k_combine(state)").alias("state"))


def heavy_hitters(events: DataFrame, ts: str, width: str, key: str, k: int, tracked: int = TRACKED) -> DataFrame:
    """window_start, key, n and rank of the k most frequent keys of each window, ties by key: exact, without a count of every
    key of every window.

    A state misses no key that more than 6 / `tracked` of a window's events hold. Its keys are counted exactly; where the
    k-th of them is held by no more than that, the window has no k keys so heavy and is counted whole.
    """
    states = tables.keep(frequent_states(events, ts, width, key, tracked))
    least = F.col("total") * 6 / tracked
    told = states.select("window_start", F.col("n").alias("total"), F.expr(f"inline_outer(approx_top_k_estimate(state, {int(tracked)}))")).select("window_start", "total", F.col("item").alias(key))
    placed = events.filter(F.col(key).isNotNull()).withColumn("window_start", F.window(ts, width)["start"])
    counted = placed.join(told.filter(F.col(key).isNotNull()), ["window_start", key]).groupBy("window_start", key).agg(F.count("*").alias("n"), F.first("total").alias("total"))
    top = tables.keep(_ranked(counted, key, k))
    sure = top.groupBy("window_start").agg(F.min("n").alias("last"), F.count("*").alias("held"), F.first("total").alias("total")).filter(((F.col("held") == k) & (F.col("last") > least)) | (least < 1)).select("window_start")
    whole = placed.join(states.select("window_start").join(sure, "window_start", "left_anti"), "window_start", "left_semi").groupBy("window_start", key).agg(F.count("*").alias("n"))
    return top.join(sure, "window_start", "left_semi").drop("total").unionByName(_ranked(whole, key, k))


def _ranked(counts: DataFrame, key: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), key))
    return counts.withColumn("rank", place).filter(F.col("rank") <= k)
