"""Betweenness of graphs that fit no single group: counts of shortest paths, level by level, from all nodes or from seeded pivots.

All pivots go at once.  Forward, each round takes the newest level of every pivot one step on and adds up path counts; backward, each
level hands its share to the level before by the same joins.  So the number of rounds is twice the depth, and a round holds a row for
a pivot and node at most.  Nodes with the same neighbours (twins) are one row with a number, as pivots and as nodes, since shortest paths cannot tell
them apart; a pivot's own twins are two steps away.  Edges count as undirected, parallel ones and loops not at all, and every step as one.

With fewer pivots than nodes a node's value is the mean over pivots, scaled to all nodes.  By Hoeffding's inequality and the union over nodes
it is off by more than error_bound() with a probability of at most `risk` for any node at all, where a pivot's share is at most 1 by (n - 1).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import broadcast_within, cut
from .graph import SMALL


def pivots_for(n: int) -> int:
    """The default number of pivots: the square root of the nodes, 64 at least, or all."""
    return min(n, max(64, math.isqrt(n)))


def error_bound(n: int, pivots: int, risk: float = 0.05) -> float:
    """How far a value may be off; 0 where all nodes are pivots.

    A pivot gives a node a share of at most (n - 2) / ((n - 1) (n - 2)) of all pairs, times n.
    """
    if pivots >= n or n < 3:
        return 0.0
    return n / (n - 1) * math.sqrt(math.log(2 * n / risk) / (2 * pivots))


def _fresh(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _twins(steps: DataFrame) -> DataFrame:
    """(node, class): nodes with the same neighbours under the least of them, of distinct steps (src, dst) that go both ways.

    The neighbours of a node are known by their number and two 64-bit hashes, so no node's list is gathered.
    """
    known = steps.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("dst")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("g"))
    known = cut(known)
    least = known.groupBy("n", "h", "g").agg(F.min("node").alias("class"))
    return known.join(least, ["n", "h", "g"]).select("node", "class")


def betweenness(edges: DataFrame, pivots: int | DataFrame | None = None, seed: int = 0, small: int = SMALL) -> DataFrame:
    """(node, betweenness, pivots) of edges (source, target), for the whole graph: 1 for a node on the only shortest path of every pair of others.

    The pivots are as many nodes as come first by a seeded hash (pivots_for() by default), or those of a table (node).
    """
    ends = edges.filter("source <> target AND source IS NOT NULL AND target IS NOT NULL")
    ways = F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))
    steps = cut(ends.select(F.inline(ways)).distinct())
    nodes = cut(steps.select(F.col("src").alias("node")).distinct())
    n = nodes.count()
    if isinstance(pivots, DataFrame):
        chosen = cut(nodes.join(pivots.select("node"), "node", "left_semi"))
        many = chosen.count()
    else:
        many = min(n, pivots_for(n) if pivots is None else pivots)
        chosen = cut(nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(many))
    classes = cut(_twins(steps))
    links = cut(steps.join(classes.filter("node = class").select(F.col("node").alias("src")), "src", "left_semi").join(classes.select(F.col("node").alias("dst"), F.col("class").alias("to")), "dst").select("src", F.col("to").alias("dst")).distinct())
    members = classes.groupBy(F.col("class").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    starts = cut(classes.join(chosen.select("node"), "node", "left_semi").groupBy(F.col("class").alias("pivot")).agg(F.count(F.lit(1)).alias("starts")).join(members.withColumnRenamed("node", "pivot"), "pivot"))
    sizes = broadcast_within(cut(members), small)
    level = _fresh(cut(starts.select("pivot", F.col("pivot").alias("node"), F.lit(1.0).alias("ways"), F.lit(1).cast("bigint").alias("size"))))
    levels = [level]
    seen = _fresh(cut(starts.filter("size = 1").select("pivot", F.col("pivot").alias("node"))))  # a pivot's twins are still to be met, two steps away
    while True:
        near = links.join(broadcast_within(level.withColumnRenamed("node", "src"), small), "src").groupBy("pivot", F.col("dst").alias("node")).agg(F.sum(F.col("ways") * F.col("size")).alias("ways"))
        new = near.join(seen, ["pivot", "node"], "left_anti").join(sizes, "node")
        level = _fresh(cut(new.select("pivot", "node", "ways", F.when(F.col("pivot") == F.col("node"), F.col("size") - 1).otherwise(F.col("size")).alias("size"))))
        if not level.limit(1).count():
            break
        levels.append(level)
        seen = _fresh(cut(seen.unionByName(level.select("pivot", "node"))))
    shares, owed = None, levels[-1].withColumn("owed", F.lit(0.0))
    for i in range(len(levels) - 1, 0, -1):
        inner = owed.select("pivot", "node", "owed")
        shares = inner if shares is None else shares.unionByName(inner)
        if i == 1:
            break
        later = owed.select("pivot", F.col("node").alias("dst"), (F.col("size") * (1 + F.col("owed")) / F.col("ways")).alias("part"))
        before = levels[i - 1]
        back = before.withColumnRenamed("node", "src").join(links, "src").join(later, ["pivot", "dst"]).groupBy("pivot", F.col("src").alias("node")).agg(F.sum("part").alias("part"))
        owed = _fresh(cut(before.join(back, ["pivot", "node"], "left").select("pivot", "node", "ways", "size", (F.col("ways") * F.coalesce("part", F.lit(0.0))).alias("owed"))))
    scale = n / many / ((n - 1) * (n - 2)) if n > 2 and many else 0.0
    if shares is None:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), F.lit(many).alias("pivots"))
    twin = F.col("pivot") == F.col("node")
    given = shares.join(broadcast_within(starts.select("pivot", "starts"), small), "pivot").groupBy(F.col("node").alias("class")).agg(F.sum(F.when(~twin, F.col("owed") * F.col("starts"))).alias("others"), F.sum(F.when(twin, F.col("owed"))).alias("twin"), F.max(F.when(twin, F.col("starts"))).alias("starts"))
    own = classes.join(broadcast_within(cut(given), small), "class", "left").join(chosen.select("node", F.lit(1).alias("is_pivot")), "node", "left")
    total = F.coalesce("others", F.lit(0.0)) + F.coalesce(F.col("twin") * (F.col("starts") - F.coalesce("is_pivot", F.lit(0))), F.lit(0.0))
    return own.select("node", (total * scale).alias("betweenness"), F.lit(many).alias("pivots"))
