"""Connected components of an edge table, by contraction along smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the component's smallest node) of all nodes in edges (a, b).

    Each round points every node at the smallest of itself and its neighbours, follows the pointers once more, and
    contracts the edges; those inside a contracted node go, so a round works on what the one before left.
    What a round has read is deleted when its results are written.  Stars of any size take one or two rounds, a path a logarithm of its length.
    """
    edges = stored(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = labels.withColumn("label", F.col("node"))
    while True:
        reverse = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        near = edges.union(reverse).groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        near = stored(near, "pointers")
        step = near.select(F.col("a").alias("to"), F.col("to").alias("then"))
        jump = near.join(step, "to").select("a", F.col("then").alias("to"))
        jump = stored(jump, "pointers")
        moved = labels.join(jump.select(F.col("a").alias("label"), "to"), "label", "left")
        after = stored(moved.select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = edges.join(jump, "a").select(F.col("to").alias("a"), "b")
        left = left.join(jump.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"))
        left = stored(left.where("a != b").distinct(), "edges")
        forget(near, jump, edges, *([labels] if hasattr(labels, "stored_path") else []))
        labels, edges = after, left
        if edges.isEmpty():
            forget(edges)
            return labels
