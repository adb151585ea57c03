"""Graph operators as bounded frontier loops over edge tables.

Each hop joins the frontier with the adjacency, drops what is known and is cut in shared storage.  A frontier of at
most `small` rows is broadcast, so the edges are not shuffled; a larger one goes through a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..plans.materialise import broadcast_within, cut

SMALL = 200_000


def adjacency(edges: DataFrame, how: str = "reference_aware") -> DataFrame:
    """(src, dst) steps of a traversal, as often as there are edges: frontiers are made distinct, not the edges.

    undirected: both ways.  reverse / forward: one way.  reference_aware: directed types forward, other types both
    ways, supersedes and contradicts not at all.
    """
    step = lambda df, a, b: df.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    if how == "forward":
        return step(edges, "source", "target")
    if how == "reverse":
        return step(edges, "target", "source")
    both_ways = F.lit(True) if how == "undirected" else ~F.col("type").isin(*schema.DIRECTED_TYPES)
    live = edges if how == "undirected" else edges.filter(~F.col("type").isin(*schema.UNTRAVERSED_TYPES))
    here, back = F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"))
    return live.select(F.inline(F.when(both_ways, F.array(here, back)).otherwise(F.array(here))))


def reachable(seeds: DataFrame, steps: DataFrame, hops: int, keys: tuple[str, ...] = (), small: int = SMALL) -> DataFrame:
    """(keys.., node, depth) within `hops` steps of seeds (keys.., node), seeds at depth 0 even without edges."""
    seen = cut(seeds.select(*keys, "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, hops + 1):
        near = steps.join(broadcast_within(frontier.select(*keys, F.col("node").alias("src")), small), "src")
        frontier = cut(near.select(*keys, F.col("dst").alias("node")).distinct().join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact(targets: DataFrame, edges: DataFrame, hops: int, small: int = SMALL) -> DataFrame:
    """(target, node, depth, via): dependents over reversed edges, each with the first edge (least ord) that found it."""
    steps = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), "ord")
    seen = cut(targets.select(F.col("node").alias("target"), "node").distinct().withColumn("depth", F.lit(0)).withColumn("via", F.lit(None).cast("bigint")))
    frontier = seen
    for depth in range(1, hops + 1):
        near = steps.join(broadcast_within(frontier.select("target", F.col("node").alias("src")), small), "src")
        found = near.groupBy("target", F.col("dst").alias("node")).agg(F.min("ord").alias("via"))
        frontier = cut(found.join(seen, ["target", "node"], "left_anti").select("target", "node", F.lit(depth).alias("depth"), "via"))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def traversed_edges(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(source, type, target, depth): edges out of every node reached in fewer than `hops` forward steps."""
    reached = reachable(seeds, adjacency(edges, "forward"), hops - 1)
    return edges.join(reached.withColumnRenamed("node", "source"), "source").select("source", "type", "target", F.col("depth").alias("depth")).distinct()


def simple_paths(sources: DataFrame, sinks: DataFrame, edges: DataFrame, cutoff: int, small: int = SMALL) -> DataFrame:
    """(path): all paths of at most `cutoff` edges without a repeated node, from a source to a sink.

    Steps that can no longer reach a sink in the hops that are left are pruned by a backward sweep first.
    """
    steps = cut(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    back = reachable(sinks.select("node"), steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), cutoff)
    useful = cut(steps.join(broadcast_within(back.select(F.col("node").alias("dst"), F.col("depth").alias("left")), small), "dst"))
    ends = sinks.select(F.col("node").alias("end")).distinct()
    paths = cut(sources.select(F.array("node").alias("path"), F.col("node").alias("src")).distinct())
    found = None
    for hop in range(1, cutoff + 1):
        longer = useful.filter(F.col("left") <= cutoff - hop).join(broadcast_within(paths, small), "src").filter(~F.array_contains("path", F.col("dst")))
        paths = cut(longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src")))
        if not paths.limit(1).count():
            break
        done = paths.join(ends, paths.src == ends.end, "left_semi").select("path")
        found = done if found is None else found.union(done)
    return found if found is not None else sources.select(F.array("node").alias("path")).limit(0)


def shortest_paths(sources: DataFrame, sinks: DataFrame, edges: DataFrame, cutoff: int, small: int = SMALL) -> DataFrame:
    """(source, sink, path): the shortest path (ties: the least) of at most `cutoff` edges from each source to each sink but itself.

    A node is kept once a source, with its least predecessor path, so what a hop holds is bounded by reached pairs and not by paths.
    """
    steps = cut(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct())
    back = reachable(sinks.select("node"), steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), cutoff)
    useful = cut(steps.join(broadcast_within(back.select(F.col("node").alias("dst"), F.col("depth").alias("left")), small), "dst"))
    frontier = seen = cut(sources.select(F.col("node").alias("source"), "node", F.array("node").alias("path")).distinct())
    for hop in range(1, cutoff + 1):
        near = useful.filter(F.col("left") <= cutoff - hop).join(broadcast_within(frontier.select("source", F.col("node").alias("src"), "path"), small), "src")
        best = near.groupBy("source", F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        frontier = cut(best.join(seen, ["source", "node"], "left_anti").select("source", "node", F.concat("path", F.array("node")).alias("path")))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    ends = sinks.select(F.col("node").alias("sink")).distinct()
    return seen.filter("source <> node").join(ends, F.col("node") == F.col("sink"), "left_semi").select("source", F.col("node").alias("sink"), "path")


def degree_centrality(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours by the other nodes of the component; 1 for a component of one node."""
    pairs = edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    of = components.join(sizes, "component").join(ends, "node", "left")
    return of.select("node", F.when(F.col("size") <= 1, 1.0).otherwise(F.coalesce("d", F.lit(0)) / (F.col("size") - 1)).alias("degree"))


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """(a, b, weight): undirected pairs; parallel edges collapse to the last by ord; reference edges weigh double."""
    last = F.max(F.struct("ord", "score", "type")).alias("e")
    pairs = edges.filter("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(last)
    return pairs.select("a", "b", (F.col("e.score") * F.when(F.col("e.type") == "reference", 2).otherwise(1)).alias("weight"))


def topological_levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """(node, level): Kahn's order level by level; nodes on or behind a cycle get level null.

    depends: (node, on).  A node's level is one more than the highest level of what it depends on.
    """
    left = cut(nodes.select("node").distinct())
    open_ = depends.select("node", "on").distinct().join(left.withColumnRenamed("node", "on"), "on", "left_semi")
    out, level = None, 0
    while True:
        ready = cut(left.join(open_, "node", "left_anti").withColumn("level", F.lit(level)))
        if not ready.limit(1).count():
            break
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(ready, "node", "left_anti"))
        open_ = cut(open_.join(ready.select(F.col("node").alias("on")), "on", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def claim_kind(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """claims (id, s, p, o) with kind: fact (is a triple), inference (two hops apart), unsupported."""
    facts = triples.select("s", "p", "o").distinct().withColumn("is_fact", F.lit(True))
    hop = triples.select("s", "o").distinct()
    asked = claims.select("s", "o").distinct()
    first = hop.select("s", F.col("o").alias("m")).join(asked.select("s").distinct(), "s", "left_semi")
    second = hop.select(F.col("s").alias("m"), "o")
    two = asked.join(first, "s").join(second, ["m", "o"]).select("s", "o").distinct().withColumn("is_near", F.lit(True))
    kind = F.when(F.col("is_fact"), "fact").when(F.col("is_near"), "inference").otherwise("unsupported")
    return claims.join(facts, ["s", "p", "o"], "left").join(two, ["s", "o"], "left").select(*claims.columns, kind.alias("kind"))


def citation_gaps(cited: DataFrame, triples: DataFrame) -> DataFrame:
    """cited (answer, pos, s, p, o) with in_graph and adjacent (null at the last citation of an answer); citations at one place of an answer follow each other by s, p, o."""
    known = triples.select("s", "p", "o").distinct().withColumn("k", F.lit(True))
    following = F.lead("s").over(W.partitionBy("answer").orderBy("pos", "s", "p", "o"))
    return cited.withColumn("following", following).join(known, ["s", "p", "o"], "left").select("answer", "pos", "s", "p", "o", F.coalesce("k", F.lit(False)).alias("in_graph"), (F.col("o") == F.col("following")).alias("adjacent"))


def citation_id(s: Column, p: Column, o: Column) -> Column:
    """Eight characters of the sha1 of a triple as a tuple of quoted strings."""
    return F.substring(F.sha1(F.format_string("('%s', '%s', '%s')", s, p, o)), 1, 8)


def mermaid(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph): the distinct steps of all paths (path) as a Mermaid graph; labels: (node, label)."""
    step = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("s")).select("s.a", "s.b").distinct()
    a, b = (labels.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")) for k in ("a", "b"))
    named = step.join(a, "a", "left").join(b, "b", "left")
    show = lambda k: F.replace(F.coalesce(f"{k}_label", F.substring(k, 1, 8)), F.lit('"'), F.lit("'"))
    line = F.format_string('  %s["%s"] --> %s["%s"]', F.substring("a", 1, 8), show("a"), F.substring("b", 1, 8), show("b"))
    lines = named.select("a", "b", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "line"))).alias("l"))
    return lines.select(F.when(F.size("l") == 0, "graph TD\n  A[No paths found]").otherwise(F.concat(F.lit("graph TD\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))).alias("graph"))
