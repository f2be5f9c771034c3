"""Connected components of an undirected graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_empty, scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node it can reach.

    Each round takes the smallest label among the neighbours, then the label of that label, so paths
    shorten by more than half a round. All steps are joins and grouped minima; a hub with many edges is a
    skewed join, which adaptive execution splits, and never a group in one task. Null ends and loops have no
    effect; no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = scratch(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    while not is_empty(labels.where("changed")):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("m"))
        step = scratch(labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid")), "step")
        jump = step.select(F.col("node").alias("at"), F.col("mid").alias("label"))
        before, labels = labels, scratch(step.join(jump, step.mid == jump["at"]).select("node", "label", (F.col("label") != F.col("old")).alias("changed")), "labels")
        discard(before, step)
    discard(both)
    return labels.select("node", F.col("label").alias("component"))
