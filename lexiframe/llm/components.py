"""Connected components of links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``links(a, b)``; the component is its smallest node.

    Each round takes the smallest label among a node's neighbours and then the label's own
    label, so that labels travel in doubling steps. Neighbours are reduced to a minimum before the
    shuffle, so a node with very many links is no special case. Tables of a round are
    written to the shared folder. No links give no rows.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(edges, "edges")
    labels = materialize(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("_near"))
        closer = labels.join(near, labels.node == near.a, "left").select(
            "node", "component", F.least("component", "_near").alias("_new")
        )
        own = labels.select(F.col("node").alias("_new"), F.col("component").alias("_of_new"))
        moved = materialize(
            closer.join(own, "_new", "left").select(
                "node", F.least("_new", "_of_new").alias("component"), (F.least("_new", "_of_new") < F.col("component")).alias("_moved")
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.where("_moved").isEmpty():
            return labels
