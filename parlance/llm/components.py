"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import cut, drop


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`node, label` (and `before`) of every node of `a, b` edges: label is the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours and then the
    label of its label, so that paths shrink by half. A round's labels are
    written to the shared folder: the next one reads files that outlive an executor. Nothing of
    the graph comes to the driver but the number of labels that changed. An
    empty edge table has no nodes; loops and repeated edges change nothing.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearest = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = cut(nearest.join(jump, "to", "left").select("node", F.col("label").alias("before"), F.least("to", F.coalesce("far", "to")).alias("label")))
        drop(labels)
        labels = after
        if after.where("label <> before").isEmpty():
            drop(both)
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
