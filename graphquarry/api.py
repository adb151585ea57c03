"""What a user calls: build and update a store, ask it, look at versions, impact, analytics and security."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schema
from .functions import text as T
from .operators import analytics, claims, context, graph, programs, retrieval, unitizer
from .plans import maintain, results
from .plans.materialise import cut
from .sources import conversations, files, store


def index(spark: SparkSession, source: str, path: str, glob: str = "*") -> maintain.Update:
    """Build or update the store at `path` from the files under `source`."""
    return maintain.update(spark, files.read_texts(spark, source, glob), path, int(time.time()))


#: Findings of each severity that a report shows.
SHOWN = {"critical": 50, "high": 30, "medium": 20, "low": 10, "info": 10}


@dataclass(frozen=True)
class Settings:
    """What a search may do; a value that is missing or makes no sense is the default."""

    expand: bool = True
    dense: bool = True
    dense_weight: float = schema.DENSE_WEIGHT

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        flag = lambda k: {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}.get(str(values.get(k, "")).strip().lower(), getattr(cls, k))
        try:
            weight = float(values.get("dense_weight", cls.dense_weight))
        except (TypeError, ValueError):
            weight = cls.dense_weight
        return cls(flag("expand"), flag("dense"), weight if 0 <= weight <= 1 else cls.dense_weight)


#: Embeddings by name; others need a model, which is not part of this library.
BACKENDS = ("hash",)


def backend(pinned: str | None = None) -> str:
    """The pinned embedding, if there is one of that name; else the first."""
    if pinned is not None and pinned not in BACKENDS:
        raise ValueError(f"no embedding is called {pinned}")
    return pinned or BACKENDS[0]


def seeds(spark: SparkSession, at: str, queries: DataFrame, k: int, settings: Settings) -> DataFrame:
    """(query_id, doc_id, score, rank): the best nodes by BM25, fused with the dense index where the settings say so."""
    posts, stats = store.read_index(spark, at)
    sparse = retrieval.bm25(retrieval.query_terms(queries), posts, stats)
    if not settings.dense or settings.dense_weight == 0:
        return retrieval.top_k(sparse, k)
    asked = retrieval.hashed_vectors(queries, "query_id", "text").select(F.col("doc_id").alias("query_id"), "slot", F.col("value").alias("asked"))
    dense = store.read_vectors(spark, at).join(asked, "slot").groupBy("query_id", "doc_id").agg(F.sum(F.col("value") * F.col("asked")).alias("score"))
    return retrieval.hybrid(sparse, dense, k, settings.dense_weight)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = schema.TOP_K, settings: Settings = Settings(dense=False)) -> DataFrame:
    """(query_id, node_id, score, rank, path, title) of (query_id, text) queries over the stored indexes."""
    at = maintain.generation(spark, path)
    best = seeds(spark, at, queries, k, settings)
    return best.withColumnRenamed("doc_id", "node_id").join(store.read_nodes(spark, at).select("node_id", "path", "title"), "node_id")


def kept_search(spark: SparkSession, path: str, queries: DataFrame, k: int = schema.TOP_K, settings: Settings = Settings(dense=False), keep_ms: int = 86_400_000) -> results.Answer:
    """search(), from the results that are kept for the store's newest version if these queries were asked of it before."""
    return results.through(spark, path, "search", queries, {"k": k, **vars(settings)}, lambda: search(spark, path, queries, k, settings), int(time.time() * 1000), keep_ms)


def ask(spark: SparkSession, path: str, queries: DataFrame, k: int = schema.TOP_K, hops: int = schema.MAX_HOPS, budget: int = schema.PACK_TOKENS, settings: Settings = Settings(dense=False)) -> DataFrame:
    """(query_id, slot, node_id, path, content): the packed context of each query."""
    from .plans import query as Q

    at = maintain.generation(spark, path)
    nodes, edges = store.read_nodes(spark, at), store.read_edges(spark, at)
    best = cut(seeds(spark, at, queries, k, settings))
    sub = cut(Q.subgraphs(best, edges, hops if settings.expand else 0))
    blocks = Q.ranked(best, sub, nodes.select("node_id", "path", "type", "token_count"), edges, queries)
    return context.packed(blocks, budget).join(nodes.select("node_id", "path", "content"), "node_id").select("query_id", "slot", "node_id", "path", "content")


def impact(spark: SparkSession, path: str, pattern: str, hops: int = 3) -> DataFrame:
    """(target, node, depth, via): dependents of all nodes whose path has a substring."""
    at = maintain.generation(spark, path)
    targets = store.read_nodes(spark, at).filter(F.contains(F.lower("path"), F.lit(pattern.lower()))).select(F.col("node_id").alias("node"))
    return graph.impact(targets, store.read_edges(spark, at), hops)


def shown(findings: DataFrame, most: dict[str, int] = SHOWN) -> DataFrame:
    """Findings (severity, ..) by severity, gravest first, at most so many of each; `hidden` tells how many more there are."""
    others = [c for c in findings.columns if c != "severity"]
    of = W.partitionBy("severity")
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col("severity")]
    ranked = findings.withColumn("shown_rank", F.row_number().over(of.orderBy(*others)))
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("all"))
    kept = ranked.join(F.broadcast(counts), "severity").filter(F.col("shown_rank") <= F.coalesce(limit, F.lit(10)))
    return kept.select(*findings.columns, F.greatest(F.lit(0), F.col("all") - F.coalesce(limit, F.lit(10))).alias("hidden"))


def classify(queries: DataFrame) -> DataFrame:
    """(query_id, class, confidence, tool) of questions."""
    q = F.col("text")
    return queries.select("query_id", T.query_class(q).alias("class"), T.code_confidence(q).alias("confidence"), T.tool(q).alias("tool"))


def read_conversations(spark: SparkSession, source: str) -> DataFrame:
    return conversations.conversations(files.read_texts(spark, source))


#: Analyses by name, for callers that dispatch on a tool's name.
TOOLS = {
    "security_scan": programs.policy_violations,
    "find_dead_code": programs.dead_code,
    "analyze_call_graph": programs.call_graph_stats,
    "analyze_recursion": programs.recursion,
    "perform_slicing": programs.backward_slice,
    "analyze_complexity": programs.complexity,
    "get_type_hierarchy": programs.hierarchy,
    "analyze_taint": programs.taint_paths,
    "analyze_chain": graph.simple_paths,
    "analyze_impact": graph.impact,
    "trending": analytics.trending,
    "emerging": analytics.emerging,
    "timeline": analytics.timeline,
    "resolve_claims": claims.temporal_edges,
    "verify_claims": claims.evaluate,
    "revise_claims": claims.revise,
    "units": unitizer.units,
}
