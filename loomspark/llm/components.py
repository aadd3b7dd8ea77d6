"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a long, b long) to (node, label): the label is the smallest node reachable.

    Each round takes the least label of all neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest path. Both joins are on a table with one row a
    node; a hub's edges are pre-aggregated before they are dealt out. Without edges: no rows.
    Self loops and repeated edges change nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = written(step.join(up, "label").select("node", "old", F.least("label", "above").alias("label")), "labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
