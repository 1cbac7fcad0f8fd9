"""Connected components of links, by exchanging least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node it is linked to over any steps.

    Nodes without links do not appear. Each round takes the least label among a node's
    neighbours and then the label of its label, so rounds go with the logarithm of the
    longest path. Labels stay in Spark and each round ends in a checkpoint.
    """
    ways = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    ways = materialize(ways.union(ways.select("other", "node")).distinct())
    labels = materialize(ways.groupBy("node").agg(F.least("node", F.min("other")).alias("component")))
    while True:
        around = ways.join(labels.select(F.col("node").alias("other"), "component"), "other")
        near = around.groupBy("node").agg(F.min("component").alias("near"))
        nearer = labels.join(near, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        root = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        moved = materialize(nearer.join(root, "via").select("node", F.least("via", "root").alias("component"), "was"))
        if moved.where("component != was").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
