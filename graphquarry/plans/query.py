"""The text query, a batch at a time: hybrid seeds, temporal filter, expansion, cap, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..operators import context as C
from ..operators import edges as E
from ..operators import graph as G
from ..operators import retrieval as R
from .materialise import cut


def subgraphs(seeds: DataFrame, edges: DataFrame, hops: int, temporal: bool = True, cap: int = schema.NODE_CAP, by_score: bool = False) -> DataFrame:
    """(query_id, node, depth): what each query's seeds reach, the first `cap` ids; with by_score the seeds come first, the best ones
    before others, and then what is nearest to them."""
    live = E.without_superseded(edges) if temporal else edges
    reached = G.reachable(seeds.select("query_id", F.col("doc_id").alias("node")), G.adjacency(live), hops, keys=("query_id",))
    order = ["node"]
    if by_score:
        reached = reached.join(seeds.select("query_id", F.col("doc_id").alias("node"), F.col("score").alias("seed_score")), ["query_id", "node"], "left")
        order = ["depth", F.desc_nulls_last("seed_score"), "node"]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return reached.withColumn("r", rank).filter(F.col("r") <= cap).drop("r", "seed_score")


def induced(sub: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, source, target, type, score, ord): edges with both ends in a query's subgraph."""
    a, b = sub.select("query_id", F.col("node").alias("source")), sub.select("query_id", F.col("node").alias("target"))
    return edges.join(a, "source").join(b, ["query_id", "target"]).select("query_id", "source", "target", "type", "score", "ord")


def ranked(seeds: DataFrame, sub: DataFrame, nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, path, importance, tokens, role) of every subgraph node.

    nodes: (node_id, path, type, token_count); seeds: (query_id, doc_id, score).
    """
    own = cut(induced(sub, edges))
    pairs = own.filter("source <> target").groupBy("query_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max(F.struct("ord", "score", "type")).alias("e"))
    pairs = pairs.select("query_id", "a", "b", (F.col("e.score") * F.when(F.col("e.type") == "reference", 2.0).otherwise(1.0)).alias("weight"))
    text = lambda df, *c: df.withColumns({x: F.col(x).cast("string") for x in c})
    central = C.centrality(text(pairs, "a", "b")).select("query_id", "node", F.col("composite").alias("centrality"))
    first = text(seeds.select("query_id", F.col("doc_id").alias("node"), F.col("score").alias("similarity")), "node")
    quality = C.qualities(first.select("query_id", "node"), text(own, "source", "target").select("query_id", "source", "target", "type"))
    rows = text(sub, "node").join(first, ["query_id", "node"], "left").join(central, ["query_id", "node"], "left").join(quality, ["query_id", "node"], "left")
    rows = rows.join(text(nodes, "node_id").withColumnRenamed("node_id", "node"), "node").join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")
    rows = rows.select(
        "query_id",
        "node",
        "path",
        "type",
        "token_count",
        "query_text",
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("centrality", F.lit(0.0)).alias("centrality"),
        F.col("similarity").isNotNull().alias("is_seed"),
        F.coalesce("quality", F.lit(0.0)).alias("path_quality"),
        F.lit(None).cast("boolean").alias("grounded"),
    )
    return rows.select("query_id", F.col("node").alias("node_id"), "path", R.importance(rows).alias("importance"), F.col("token_count").alias("tokens"), F.col("type").alias("role"))


def answer(queries: DataFrame, docs: DataFrame, edges: DataFrame, k: int = schema.TOP_K, hops: int = schema.MAX_HOPS, budget: int = schema.PACK_TOKENS) -> DataFrame:
    """(query_id, node_id, slot): the packed context of each query over documents (node_id, path, type, token_count, text)."""
    terms = R.query_terms(queries)
    posts, stats = R.postings(docs, "node_id", "text", terms), R.doc_stats(docs, "node_id", "text")
    seeds = cut(R.top_k(R.bm25(terms, posts, stats), k))
    sub = cut(subgraphs(seeds, edges, hops))
    blocks = ranked(seeds, sub, docs.select("node_id", "path", "type", "token_count"), edges, queries)
    return C.packed(blocks, budget)
