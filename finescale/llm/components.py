"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.shared import discard, written


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes of ``a, b``. In a round each node takes the smallest label of its
    neighbours, then that label's own label; a path of n links takes some log n rounds. Sums by key are partial before any
    shuffle, and no label is collected."""
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").filter("node <> other").distinct(), "edges")
    last = written(both.groupBy("node").agg(F.least(F.min("node"), F.min("other")).alias("component")), "labels")
    labels = last
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = written(near.join(jump, "near").select("node", "old", F.least("near", "far").alias("component")), "labels")
        discard(last)
        last, labels = new, new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            discard(both)
            return labels
