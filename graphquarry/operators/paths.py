"""Weighted shortest paths of many subgraphs at once, by relaxing edges bucket by bucket.

A row is a node of one subgraph as one seed sees it, so what a round holds is bounded by seeds and nodes, not by paths, and all subgraphs go
in one plan.  A round takes the nodes whose distance is within `width` of the least open one of their seed, relaxes their edges by
one join, and keeps what got nearer; nodes come back as often as they get nearer within a bucket.  Weights are positive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.materialise import broadcast_within, cut
from .graph import SMALL

#: Sums of weights that differ by less are equal.
EQUAL = 1e-9


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, since unions trip over constraints that a checkpoint keeps on columns it dropped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _steps(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    ways = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in (("a", "b"), ("b", "a"))])
    return pairs.select(*keys, F.inline(ways), *[c for c in pairs.columns if c not in (*keys, "a", "b")])


def distances(seeds: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("query_id",), width: float = 1.0, small: int = SMALL) -> DataFrame:
    """(keys.., seed, node, distance) of seeds (keys.., node) over undirected pairs (keys.., a, b, weight); seeds at 0."""
    steps = cut(_steps(pairs.select(*keys, "a", "b", "weight"), keys))
    own = [*keys, "seed", "node"]
    best = _fresh(cut(seeds.select(*keys, F.col("node").alias("seed"), "node").distinct().withColumn("distance", F.lit(0.0))))
    active = best
    while active.limit(1).count():
        least = F.min("distance").over(W.partitionBy(*keys, "seed"))
        marked = _fresh(cut(active.withColumn("near", F.col("distance") < least + width)))
        near = broadcast_within(marked.filter("near").select(*keys, "seed", F.col("node").alias("src"), "distance"), small)
        reached = steps.join(near, [*keys, "src"]).groupBy(*keys, "seed", F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("distance"))
        old = best.withColumnRenamed("distance", "old")
        nearer = _fresh(cut(reached.join(old, own, "left").filter(F.col("old").isNull() | (F.col("distance") < F.col("old") - EQUAL)).select(*own, "distance")))
        gone = nearer.select(*own)
        best = _fresh(cut(best.join(gone, own, "left_anti").select(*best.columns).unionByName(nearer)))
        active = _fresh(cut(marked.filter("NOT near").select(*best.columns).join(gone, own, "left_anti").select(*best.columns).unionByName(nearer)))
    return best


def closeness(nodes: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("query_id",), width: float = 1.0) -> DataFrame:
    """(keys.., node, closeness): the other nodes of a node's component by the sum of its distances from them; 0 for a node alone."""
    far = distances(nodes, pairs, keys, width).groupBy(*keys, F.col("seed").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("total"))
    return far.select(*keys, "node", F.when(F.col("total") > 0, (F.col("n") - 1) / F.col("total")).otherwise(0.0).alias("closeness"))


def predecessors(best: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(keys.., seed, node, before, the pairs' other columns): the last step of the shortest path to each node but the seed; ties: the least node before."""
    steps = _steps(pairs, keys)
    u = best.select(*keys, "seed", F.col("node").alias("src"), F.col("distance").alias("so_far"))
    v = best.select(*keys, "seed", F.col("node").alias("dst"), "distance")
    tight = steps.join(u, [*keys, "src"]).join(v, [*keys, "seed", "dst"]).filter((F.abs(F.col("so_far") + F.col("weight") - F.col("distance")) <= EQUAL) & (F.col("so_far") < F.col("distance")))
    rest = [c for c in pairs.columns if c not in (*keys, "a", "b")]
    last = tight.groupBy(*keys, "seed", F.col("dst").alias("node")).agg(F.min(F.struct(F.col("src").alias("before"), *rest)).alias("last"))
    return last.select(*keys, "seed", "node", "last.*")


def best_routes(seeds: DataFrame, pairs: DataFrame, titles: DataFrame, k: int = 5, width: float = 1.0) -> DataFrame:
    """(query_id, rank, path, score, narrative): the k shortest paths from the seeds with the highest sum of scores; ties: the least path.

    pairs: (query_id, a, b, weight, score, label); seeds: (query_id, node); titles: (node, title).  A path is told as its
    titles and labels.  Paths grow from the seeds, a step a round, each from its node's one predecessor.
    """
    inside = pairs.select("query_id", F.col("a").alias("node")).union(pairs.select("query_id", "b")).distinct()
    best = distances(seeds.join(inside, ["query_id", "node"], "left_semi"), pairs, width=width)
    named = predecessors(best, pairs).join(titles, "node").select("query_id", "seed", F.col("before").alias("at"), F.col("node").alias("next"), "score", F.concat(F.lit(" → "), "title", F.lit(" ["), "label", F.lit("]")).alias("told_step"))
    last = cut(named)
    first = best.filter("seed = node").join(titles, "node").select("query_id", "seed", "node", F.array("node").alias("path"), F.lit(0.0).alias("total"), F.col("title").alias("told"))
    frontier = _fresh(cut(first))
    found = None
    while True:
        longer = last.join(frontier.withColumnRenamed("node", "at"), ["query_id", "seed", "at"])
        frontier = _fresh(cut(longer.select("query_id", "seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), (F.col("total") + F.col("score")).alias("total"), F.concat("told", "told_step").alias("told"))))
        if not frontier.limit(1).count():
            break
        found = frontier if found is None else found.unionByName(frontier)
    if found is None:
        found = frontier
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("total", 9)), "path")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "path", F.col("total").alias("score"), F.col("told").alias("narrative"))
