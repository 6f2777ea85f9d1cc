"""Sliding ranges over events and over counters that may be reset, by panes.

A pane is as long as a step. Rows are reduced to one state a pane and series first; a range is then folded from its
panes, so a row is counted once however many ranges hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MICRO = 1_000_000


def _pane(ts: str, step: int) -> Column:
    """The start of a time's pane, in microseconds."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return micros - F.pmod(micros, F.lit(step * _MICRO))


def _starts(pane: Column, seconds: int, step: int) -> Column:
    """The starts of the ranges that hold a pane."""
    if seconds % step:
        raise ValueError("a range has to be a multiple of its step")
    return F.explode(F.sequence(pane - (seconds - step) * _MICRO, pane, F.lit(step * _MICRO)))


def sliding_rate(events: DataFrame, ts: str, seconds: int, step: int, *by: str, condition: Column | None = None) -> DataFrame:
    """window_start, n and rate (a second) of every range of `seconds`, one each `step` seconds, that holds an event; with a
    condition also n_met and ratio. Events without a time are left out."""
    met = [F.count_if(condition).alias("_met")] if condition is not None else []
    panes = events.filter(F.col(ts).isNotNull()).groupBy(*by, _pane(ts, step).alias("_pane")).agg(F.count("*").alias("_n"), *met)
    sums = [F.sum("_n").alias("n"), *([F.sum("_met").alias("n_met")] if met else [])]
    out = panes.withColumn("_start", _starts(F.col("_pane"), seconds, step)).groupBy(*by, "_start").agg(*sums)
    told = [F.col("n_met"), (F.col("n_met") / F.col("n")).alias("ratio")] if met else []
    return out.select(F.timestamp_micros("_start").alias("window_start"), *by, "n", (F.col("n") / seconds).alias("rate"), *told)


def pane_states(samples: DataFrame, ts: str, value: str, step: int, *by: str) -> DataFrame:
    """A state for each pane of a counter's series: first and last sample, number, and increase between neighbours. A sample
    below the one before it begins anew from 0. Samples of one time are in order of value; those without time or value
    are left out."""
    rows = samples.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).select(*by, _pane(ts, step).alias("_pane"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), F.col(value).alias("_v"))
    before = F.lag("_v").over(Window.partitionBy(*by, "_pane").orderBy("_t", "_v"))
    grown = rows.withColumn("_d", F.when(before.isNull(), F.lit(0)).when(F.col("_v") < before, F.col("_v")).otherwise(F.col("_v") - before))
    sample = F.struct("_t", "_v")
    return grown.groupBy(*by, "_pane").agg(F.min(sample).alias("first"), F.max(sample).alias("last"), F.count("*").alias("n"), F.sum("_d").alias("inc"))


def increase(samples: DataFrame, ts: str, value: str, seconds: int, step: int, *by: str) -> DataFrame:
    """window_start, n, raw, increase and rate of a counter over every range of `seconds`, one each `step` seconds, that holds
    two samples or more.

    `raw` is the growth between the range's samples, resets told from falls. `increase` carries it on to the range's ends:
    as far as 1.1 mean distances between samples, else half a mean distance, and never to where the counter was below 0.
    """
    panes = pane_states(samples, ts, value, step, *by).withColumn("_start", _starts(F.col("_pane"), seconds, step))
    state = F.struct("_pane", "first", "last", "n", "inc")
    folded = panes.groupBy(*by, "_start").agg(F.array_sort(F.collect_list(state)).alias("_panes"))  # seconds / step states at most

    def merge(a: Column, b: Column) -> Column:
        between = F.when(b["first"]["_v"] < a["last"]["_v"], b["first"]["_v"]).otherwise(b["first"]["_v"] - a["last"]["_v"])
        return F.struct(a["_pane"].alias("_pane"), a["first"].alias("first"), b["last"].alias("last"), (a["n"] + b["n"]).alias("n"), (a["inc"] + between + b["inc"]).alias("inc"))

    one = folded.select(*by, "_start", F.reduce(F.slice("_panes", 2, F.size("_panes")), F.get("_panes", F.lit(0)), merge).alias("_s")).filter("_s.n >= 2")
    first, last, inc = F.col("_s.first"), F.col("_s.last"), F.col("_s.inc").cast("double")
    sampled = (last["_t"] - first["_t"]).cast("double")
    mean = sampled / (F.col("_s.n") - 1)
    to_start, to_end = (first["_t"] - F.col("_start")).cast("double"), (F.col("_start") + seconds * _MICRO - last["_t"]).cast("double")
    near = lambda d: F.when(d >= mean * 1.1, mean / 2).otherwise(d)
    to_zero = F.when((inc > 0) & (first["_v"] >= 0), sampled * (first["_v"].cast("double") / inc))
    reach = F.least(near(to_start), F.coalesce(to_zero, near(to_start)))
    grown = F.when(sampled > 0, inc * ((sampled + reach + near(to_end)) / sampled)).otherwise(inc)
    out = one.select(F.timestamp_micros("_start").alias("window_start"), *by, F.col("_s.n").alias("n"), F.col("_s.inc").alias("raw"), grown.alias("increase"))
    return out.withColumn("rate", F.col("increase") / seconds)


def top_increase(increases: DataFrame, k: int, *by: str) -> DataFrame:
    """The k series of most increase in each range; ties by name."""
    place = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("increase"), *by))
    return increases.withColumn("rank", place).filter(F.col("rank") <= k)
