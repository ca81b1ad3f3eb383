"""Connected components of a table of links, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long).

    Each round takes the smallest label among the neighbours and then the label's own label, so labels
    travel at doubling speed along chains. Every round is written to the shared folder."""
    both = scratch.save(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = scratch.save(step.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("after")), "round")
        scratch.drop("round", last=1)
        labels = after.select("node", F.col("after").alias("label"))
        if after.where("after <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
