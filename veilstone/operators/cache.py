"""Work shared between equal texts, cache statistics with expiry, and the circuit breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def cache_key(text: Column, labels: list[str] | None = None) -> Column:
    """sha256 of the text and the sorted labels asked for."""
    return F.sha2(F.concat(text, F.lit("::" + ",".join(sorted(labels or [])))), 256)


def once_each(df: DataFrame, text: str, work: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """`work` on distinct texts only, joined back to all rows. A null text is left out of the work and gets nulls."""
    keyed = df.withColumn(key, F.sha2(F.col(text), 256))
    distinct = keyed.filter(F.col(text).isNotNull()).groupBy(key).agg(F.first(text).alias(text))
    return keyed.join(work(distinct).drop(text), key, "left")


def dedupe_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """total, size (distinct texts), hits, misses and hit_rate (4 places) of a cache without bounds."""
    sizes = df.groupBy(F.sha2(F.col(text), 256).alias("k")).agg(F.count("*").alias("n"))
    total, size = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return sizes.agg(total.alias("total"), size.alias("size"), (total - size).alias("hits"), size.alias("misses"), F.coalesce(F.round((total - size) / total, 4), F.lit(0.0)).alias("hit_rate"))


def _folded(events: DataFrame, key: str, columns: list[Column], out: str, start: Callable[[], tuple], step: Callable) -> DataFrame:
    """`step(state, *values)` over each key's rows in the order of `columns`, which gives the next state and an output row.

    Rows stream through a task in order, a batch at a time, so memory does not follow a key's rows. An automaton that
    needs each state for the next one is a key's own sequence: other keys run beside it.
    """
    names = [f"_v{k}" for k in range(len(columns))]
    rows = events.select(F.col(key).alias("_key"), *(c.alias(n) for c, n in zip(columns, names, strict=True)))

    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    names_out, types = zip(*(x.split() for x in out.split(", ")), strict=True)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, start()
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), []
            for k, *values in zip(keys, *(batch.column(i + 1).to_pylist() for i in range(len(names))), strict=True):
                if held is None or k != held[0]:
                    held, state = (k,), start()
                state, row = step(state, *values)
                done.append(row)
            fields = list(zip(*done, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f, kinds[n]) for f, n in zip(fields, types, strict=True))], names=["_key", *names_out])

    kind = events.schema[key].dataType.simpleString()
    return rows.repartition("_key").sortWithinPartitions("_key", *names).mapInArrow(fold, f"_key {kind}, {out}").withColumnRenamed("_key", key)


def expiring_hits(requests: DataFrame, key: str, ts: str, ttl_seconds: int = 300) -> DataFrame:
    """key, ts and hit of each request: whether the entry stored for the key is not older than the time to live. An entry is
    stored at a miss."""
    ttl = ttl_seconds * 1_000_000

    def step(stored: int | None, t: int) -> tuple:
        hit = stored is not None and t - stored <= ttl
        return (stored if hit else t), (t, hit)

    return _folded(requests, key, [_micros(ts)], "t long, hit boolean", lambda: None, step).select(key, F.timestamp_micros("t").alias(ts), "hit")


def breaker(events: DataFrame, key: str, ts: str, ok: str, threshold: int = 10, recovery_seconds: int = 30, half_open: int = 3) -> DataFrame:
    """key, ts, state and failures behind each event, by an ordered fold over the key's events.

    `threshold` failures in a row open the breaker; `recovery_seconds` later the next event finds it half open;
    `half_open` successes then close it and any failure opens it again. Of events at one time failures come first.
    """
    wait = recovery_seconds * 1_000_000

    def step(held: tuple, t: int, good_event: bool) -> tuple:
        state, failures, good, opened = held
        if state == "open" and t - opened >= wait:
            state, good = "half_open", 0
        if good_event:
            failures = 0
            if state == "half_open":
                good += 1
                state = "closed" if good >= half_open else state
        else:
            failures += 1
            if state == "half_open" or failures >= threshold:
                state, opened = "open", t
        return (state, failures, good, opened), (t, state, failures)

    done = _folded(events, key, [_micros(ts), F.col(ok)], "t long, state string, failures int", lambda: ("closed", 0, 0, None), step)
    return done.select(key, F.timestamp_micros("t").alias(ts), "state", F.col("failures").cast("int").alias("failures"))
