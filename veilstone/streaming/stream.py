"""Structured Streaming: stateless redaction of samples, fan-out to several sinks, windowed metrics, duplicates."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import suppress
from datetime import datetime
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from veilstone.operators.redact import Options
from veilstone.operators.views import shortened
from veilstone.plans.samples import redact_samples, reviewer_samples


def redact_stream(samples: DataFrame, options: Options | None = None, reviewer: bool = True) -> DataFrame:
    """Samples are redacted one by one, so nothing is kept between batches and output can be appended."""
    done = redact_samples(samples, options)
    return reviewer_samples(done) if reviewer else done


def fan_out(stream: DataFrame, handlers: list[Callable[[DataFrame, int], None]], checkpoint: str, drain: bool = True, on_error: Callable[[Exception], None] | None = None) -> StreamingQuery:
    """Every handler sees every batch, computed once; a handler that fails does not keep the others from theirs."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for handle in handlers:
                try:
                    handle(batch, number)
                except Exception as e:
                    if on_error is None:
                        raise
                    on_error(e)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()


class MemorySink:
    """A handler for fan_out() that holds `most` rows at most: the newest ones by the column `order`, or without one the
    latest batches' first ones. What does not fit is never brought to the driver."""

    def __init__(self, most: int = 1000, order: str | None = None):
        self.rows: deque = deque(maxlen=most)
        self.order, self.seen = order, 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.seen += batch.count()
        if self.order is None:
            self.rows.extend(batch.limit(self.rows.maxlen).collect())
            return
        newest = batch.orderBy(F.desc_nulls_last(self.order)).limit(self.rows.maxlen).collect()
        least = min((r[self.order] for r in [*self.rows, *newest] if r[self.order] is not None), default=None)
        known = sorted([*self.rows, *newest], key=lambda r: (r[self.order] is not None, least if r[self.order] is None else r[self.order]))
        self.rows.clear()
        self.rows.extend(known)


def print_sink(length: int = 120, most: int = 20, out: Callable[[str], None] = print) -> Callable[[DataFrame, int], None]:
    """A handler for fan_out() that prints the first rows of a batch, prompts and responses shortened."""

    def handle(batch: DataFrame, number: int) -> None:
        cut = [shortened(F.col(c), length).alias(c) if c in ("prompt", "response") else F.col(c) for c in batch.columns]
        for row in batch.select(*cut).limit(most).collect():
            out(f"{number}: {row.asDict()}")

    return handle


def bounded_source(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", most_files: int | None = None, most_bytes: str | None = None) -> DataFrame:
    """A stream of files that a batch takes only so many of, or so many bytes of: what waits stays in its folder."""
    if (most_files is None) == (most_bytes is None):
        raise ValueError("either a number of files or of bytes")
    limit = ("maxFilesPerTrigger", most_files) if most_files is not None else ("maxBytesPerTrigger", most_bytes)
    return spark.readStream.schema(schema).format(file_format).option(*limit).load(path)


class Intake:
    """A handler for fan_out() that gives another one `most` rows at a time at most, in turn, and measures what came.

    `batches` has the rows of each batch, `largest` the most rows that were handed over at once. A batch is cut by the
    places of its rows, each row in exactly one piece, without a shuffle and without bringing rows to the driver.
    """

    def __init__(self, handle: Callable[[DataFrame, int], None], most: int):
        self.handle, self.most = handle, most
        self.batches: dict[int, int] = {}
        self.largest = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        from veilstone import tables

        held = tables.keep(batch.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - (F.col("_part").cast("long") * (1 << 33))), scope := f"intake-{number}")
        sizes = sorted(held.groupBy("_part").count().collect())  # a row a partition of the batch
        self.batches[number] = sum(r["count"] for r in sizes)
        pieces: list[tuple[int, list[tuple[int, int, int]]]] = []
        for r in sizes:
            at = 0
            while at < r["count"]:
                if not pieces or pieces[-1][0] == self.most:
                    pieces.append((0, []))
                take = min(self.most - pieces[-1][0], r["count"] - at)
                pieces[-1] = (pieces[-1][0] + take, [*pieces[-1][1], (r["_part"], at, at + take)])
                at += take
        try:
            for n, parts in pieces:
                own = reduce(or_, ((F.col("_part") == p) & (F.col("_at") >= a) & (F.col("_at") < b) for p, a, b in parts))
                self.handle(held.filter(own).drop("_part", "_at"), number)
                self.largest = max(self.largest, n)
        finally:
            tables.release(batch.sparkSession, scope)


class ProgressGauges(StreamingQueryListener):
    """Gauges of all streaming queries, from their progress: rows of a batch, rows a second in and out, seconds of a batch, rows
    and bytes of state, rows dropped as late, and whatever backlog the sources tell. The newest `most` samples are held.

        gauges = ProgressGauges(); spark.streams.addListener(gauges); ...; metrics.gauges(gauges.to_df(spark))
    """

    SCHEMA = "query string, name string, ts timestamp, batch long, value double"

    def __init__(self, most: int = 10_000):
        self.samples: deque = deque(maxlen=most)
        self.active: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.active.add(str(event.id))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.active.discard(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        told = {"rows": p.numInputRows, "rows_in_per_second": p.inputRowsPerSecond, "rows_out_per_second": p.processedRowsPerSecond, "batch_seconds": p.durationMs.get("triggerExecution", 0) / 1000}
        if p.stateOperators:
            told |= {"state_rows": sum(s.numRowsTotal for s in p.stateOperators), "state_bytes": sum(s.memoryUsedBytes for s in p.stateOperators), "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        for source in p.sources:
            for name, value in (source.metrics or {}).items():
                with suppress(ValueError, TypeError):
                    told[f"backlog_{name}"] = told.get(f"backlog_{name}", 0.0) + float(value)
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        self.samples.extend((p.name or str(p.id), name, at, p.batchId, float(value)) for name, value in told.items() if value is not None and value == value)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.samples), self.SCHEMA)


def rate_stream(events: DataFrame, ts: str, width: str, seconds: int, late: str, *by: str) -> DataFrame:
    """Events a second of each window, closed once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("_w"), *by).agg((F.count("*") / seconds).alias("rate")).select(F.col("_w.start").alias("window_start"), *by, "rate")


def fresh_texts(samples: DataFrame, ts: str, text: str = "prompt", ttl: str = "5 minutes") -> DataFrame:
    """Texts not seen within the time to live."""
    return samples.withColumn("_key", F.sha2(F.col(text), 256)).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


class BreakerProcessor(StatefulProcessor):
    """The circuit breaker as streaming state: state, failures, successes since half open and time of opening a key."""

    def __init__(self, threshold: int = 10, recovery_seconds: float = 30.0, half_open: int = 3):
        self.threshold, self.recovery, self.half_open = threshold, recovery_seconds, half_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("breaker", "state string, failures int, good int, opened double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state, failures, good, opened = self.held.get() if self.held.exists() else ("closed", 0, 0, 0.0)
        out = []
        for event in pd.concat(list(rows)).sort_values("ts").itertuples():
            now = event.ts.timestamp()
            if state == "open" and now - opened >= self.recovery:
                state, good = "half_open", 0
            if event.ok:
                failures = 0
                if state == "half_open":
                    good += 1
                    state = "closed" if good >= self.half_open else state
            else:
                failures += 1
                if state == "half_open" or failures >= self.threshold:
                    state, opened = "open", now
            out.append((key[0], event.ts, state, failures))
        self.held.update((state, failures, good, opened))
        yield pd.DataFrame(out, columns=["key", "ts", "state", "failures"])

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, **limits) -> DataFrame:
    """key, ts, state and failures behind each event of a stream (key, ts, ok)."""
    return events.groupBy("key").transformWithStateInPandas(BreakerProcessor(**limits), "key string, ts timestamp, state string, failures int", "append", "none")
