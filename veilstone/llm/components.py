"""Connected components of a link table, by least labels and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstone.llm import store


def components(links: DataFrame, scope: str = "query") -> DataFrame:
    """node and component (the least node it reaches) of each node of `links` (a, b), given in either direction or both.

    A round takes the least label of a node's neighbours, then the label of that label; labels only fall, so their sum
    tells when nothing changes. Rounds grow with the logarithm of a component's diameter in practice.
    """
    both = store.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), scope)
    labels = store.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), scope)
    total = lambda t: t.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    before = total(labels)
    while before is not None:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        fallen = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("component"))
        up = fallen.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        after = store.keep(fallen.join(up, F.col("component") == F.col("_n")).select("node", F.least("component", "_c").alias("component")), scope)
        store.discard(labels)
        now, labels = total(after), after
        if now == before:
            break
        before = now
    store.discard(both)
    return labels
