"""Connected components of a large edge table, by shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listenlake.runtime import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs to (node, component): the smallest node that each node reaches.

    Labels fall to the least label among the neighbours, then jump to their label's own label,
    so a chain of n nodes needs about log n rounds. Each round is a join and a map-side combined
    minimum, written to the shared folder: no lineage grows and nothing is collected.
    No edges give an empty table; loops and repeated edges change nothing.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        seen = labels.select(F.col("a").alias("b"), F.col("c").alias("nc"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("nc").alias("m"))
        low = labels.join(least, "a").select("a", "c", F.least("c", "m").alias("m"))
        jump = labels.select(F.col("a").alias("m"), F.col("c").alias("up"))
        new = materialize(low.join(jump, "m", "left").select("a", F.least("m", "up").alias("c"), (F.least("m", "up") < F.col("c")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if new.where("moved").isEmpty():
            break
    discard(both)
    return labels.select(F.col("a").alias("node"), F.col("c").alias("component"))
