"""Connected components of a graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import cut


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of its component for every node of ``pairs``.

    Each round a node takes the least label among its own, its neighbours' and its label's own label (a shortcut), so
    chains shrink by doubling. Labels are least values, combined before each shuffle; nothing but a count of changes
    reaches the driver. Null ends are ignored, loops keep their node, an empty input gives no node.
    """
    both = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    edges = cut(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = cut(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("n"), F.col("component").alias("c")), F.col("y") == F.col("n"))
            .groupBy("x")
            .agg(F.min("c").alias("near"))
        )
        better = labels.join(near, F.col("node") == F.col("x"), "left").select("node", "component", F.least("component", "near").alias("next"))
        jump = better.select(F.col("node").alias("j"), F.col("next").alias("to"))
        moved = cut(better.join(jump, F.col("next") == F.col("j"), "left").select("node", "component", F.least("next", "to").alias("next")))
        changed = moved.filter("next <> component").limit(1).count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
