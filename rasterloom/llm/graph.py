"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of an edge list (a, b); the component is its smallest node.

    Each round, a node takes the smallest label among itself, its neighbours and the node that its label names. The
    labels are written to shared storage after every round, and rounds end when none changes. A star needs two rounds,
    a chain a number of rounds that grows with the logarithm of its length for the most part.
    """
    n = 2 * edges.count()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.stage(both, "edges", n)
    labels = common.stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", n)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        far = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        stepped = labels.join(near, labels["node"] == near["a"], "left").join(far, F.col("component") == F.col("via"), "left")
        best = F.least("component", "near", "far")
        stepped = common.stage(stepped.select("node", best.alias("component"), (best < F.col("component")).alias("moved")), "labels", n)
        labels = stepped.select("node", "component")
        if stepped.where("moved").isEmpty():
            return labels
