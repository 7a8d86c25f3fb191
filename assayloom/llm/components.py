"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order, loops and repeats allowed -> (node, component): the least node reachable.

    Each round takes the least label among a node and its neighbours, then replaces a label by
    its own label, so long chains halve. Only the number of changed labels reaches the driver;
    each round is a written table, so a lost executor costs one round at most. Groups are min()
    aggregates, combined before the shuffle, and hubs meet only in joins that AQE can split.
    """
    pairs = edges.where("a is not null and b is not null and a != b")
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        target = labels.select(F.col("node").alias("component"), F.col("component").alias("target"))
        moved = materialize(step.join(target, "component", "left").select("node", "old", F.coalesce(F.least("component", "target"), "component").alias("component")))
        labels = moved.select("node", "component")
        if moved.where("old != component").isEmpty():
            return labels
