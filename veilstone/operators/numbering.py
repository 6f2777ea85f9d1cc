"""Corpus-wide numbering that goes on from run to run: a token table that batches of entities are merged into.

The table is a folder with a folder of Parquet files for each batch, written once; a batch counts when Spark's _SUCCESS
marker stands in its folder. A batch numbers only pairs that no earlier batch holds, from the counters that these left.
A batch that comes again, after a crash or in a stream's replay, is read if it was committed and written anew if not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilstone import tables
from veilstone.operators.tokens import ranged_number, token

_SCHEMA = "label string, value string, number long, token string"


class TokenTable:
    """The numbers of all (label, value) pairs seen so far, under `path`. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> dict[str, int]:
        """Committed folders: `upto=N` holds what all batches to N gave, `batch=N` what batch N added."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return {}
        names = [f.getPath().getName() for f in system.listStatus(at) if f.isDirectory()]
        done = lambda n: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return {n: int(n.partition("=")[2]) for n in names if n.startswith(("batch=", "upto=")) and done(n)}

    def committed(self) -> int:
        """The last batch that is committed, or -1."""
        return max(self._folders().values(), default=-1)

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/{n}" for n in sorted(names)))

    def state(self, before: int | None = None) -> DataFrame:
        """label, value, number and token of all pairs, or of those that batches before `before` gave."""
        folders = self._folders()
        base = max((b for n, b in folders.items() if n.startswith("upto=") and (before is None or b < before)), default=-1)
        names = [n for n, b in folders.items() if (n.startswith("batch=") and b > base and (before is None or b < before)) or n == _upto(base)]
        return self._read(names)

    def add(self, entities: DataFrame, order: list[str], batch: int) -> DataFrame:
        """Number the pairs of `entities` (a row each, in order of the columns `order`) that are new, as batch number `batch`;
        gives the rows added. Numbers are those of one run over all batches in turn."""
        last = self.committed()
        if batch <= last:
            return self._read([n for n, b in self._folders().items() if n == _batch(batch)])
        scope = f"numbering-{batch}"
        earlier = self.state()
        first = entities.groupBy("label", "value").agg(F.min(F.struct(*order)).alias("_first"))
        new = first.join(earlier.select("label", "value"), ["label", "value"], "left_anti")
        counters = earlier.groupBy("label").agg(F.max("number").alias("_last"))  # a row a label
        shifted = ranged_number(new, "label", "_first", scope=scope).join(counters, "label", "left").withColumn("number", F.col("number") + F.coalesce("_last", F.lit(0)))
        shifted.select("label", "value", "number", token(F.col("label"), F.col("number")).alias("token")).write.mode("overwrite").parquet(f"{self.path}/{_batch(batch)}")
        tables.release(self.spark, scope)
        return self._read([_batch(batch)])

    def compact(self) -> None:
        """Write the state as one folder, so that reading it does not grow with the number of batches; older ones go."""
        last, old = self.committed(), self._folders()
        if last < 0 or list(old) == [_upto(last)]:
            return
        self.state().write.mode("overwrite").parquet(f"{self.path}/{_upto(last)}")
        for name in old:
            if name != _upto(last):
                tables.delete(self.spark, f"{self.path}/{name}")

    def tokenised(self, entities: DataFrame) -> DataFrame:
        """`entities` with the number and token of each."""
        return entities.drop("number", "token").join(self.state(), ["label", "value"], "left")


def _batch(n: int) -> str:
    return f"batch={n:09d}"


def _upto(n: int) -> str:
    return f"upto={n:09d}"


def numbered_stream(entities: DataFrame, path: str, order: list[str], checkpoint: str, handle=None, drain: bool = True, compact_every: int = 100) -> StreamingQuery:
    """Each micro-batch of a stream of entities numbered on from the table under `path`; `handle` gets the batch's entities
    with their tokens. A replayed batch has the same number, and so the same tokens."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            table = TokenTable(batch.sparkSession, path)
            table.add(held, order, number)
            if handle is not None:
                handle(table.tokenised(held), number)
            if compact_every and number % compact_every == compact_every - 1:
                table.compact()
        finally:
            held.unpersist()

    writer = entities.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer).start()
