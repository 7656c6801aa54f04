"""Connected components of a graph that only the cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b: long) can reach.

    Every round takes the smallest label of the neighbours and then the label's own label, so that long chains
    shrink fast. Each round's labels are stored; the number of rounds grows with the logarithm of a chain's length.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "c", F.least("c", "m").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("c").alias("u"))
        new = stored(step.join(up, "m", "left").select("node", F.least("m", "u").alias("n"), "c"))
        moved = not new.filter("n < c").isEmpty()
        labels = new.select("node", F.col("n").alias("c"))
        if not moved:
            return labels.withColumnRenamed("c", "component")
