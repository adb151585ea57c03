"""Connected components of an undirected edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.  Null ends are ignored.

    Each round moves every label to the least label around it and then to that label's own label, so a chain
    halves in each round.  Rounds are cut in the shared checkpoint folder.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut(moved.join(hop, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
