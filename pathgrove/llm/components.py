"""Connected components of an edge table, by smallest neighbour and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise, release


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a long, b long).

    Each round a node takes the smallest label among its own and its neighbours', then the label of that label; rounds are written
    tables. The minimum is combined before the shuffle, so a node with very many edges is no hot spot."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    written = labels
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels.node == heard.a).select("node", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("target"), F.col("label").alias("jumped"))
        after = near.join(jump, near.near == jump.target, "left").select(
            "node", F.least("near", F.coalesce("jumped", "near")).alias("label"), (F.least("near", F.coalesce("jumped", "near")) < F.col("label")).alias("moved")
        )
        after = materialise(after, "labels")
        release(written)
        written, labels = after, after.select("node", "label")
        if not after.where("moved").limit(1).count():
            release(both)
            return labels.withColumnRenamed("label", "component")
