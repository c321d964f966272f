"""Connected components of a graph of pairs, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathline.llm.batches import settle


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node that links reach, for every node of an edge.

    Each round a node takes the smallest label next to it, then its label's own label, so
    that the number of rounds goes with the logarithm of a chain's length. Minima are
    taken before the shuffle, so a node with very many links does no harm. Rounds are
    written to the shared folder; the loop ends when no label falls.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = settle(both.distinct(), f"{name}-edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("m"))
        step = labels.join(near, labels.node == near.n).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("label"), F.col("label").alias("over"))
        step = step.join(up, "label").select("node", "was", F.least("label", "over").alias("label"))
        step = settle(step, name)
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
