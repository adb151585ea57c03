"""The graph store: nodes, edges, postings, vectors, bookmarks and code-property graphs as Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .. import schema
from ..operators import retrieval as R
from . import graphml as G


def folders(at: str) -> list[str]:
    """The folders of a version, oldest first: "store/generation-1,generation-2" has the rows of both."""
    base, _, chain = at.rpartition("/")
    return [f"{base}/{g}" if base else g for g in chain.split(",")]


def _schema(spark: SparkSession, paths: list[str], empty: str | None = None) -> StructType | str:
    """The schema of the first of the paths that has rows (a table by type without rows has no files), or else `empty`."""
    for path in paths:
        try:
            return spark.read.parquet(path).schema
        except AnalysisException:
            continue
    if empty:
        return empty
    raise ValueError(f"no rows in {', '.join(paths)}")


def _live(spark: SparkSession, at: str, table: str, gone: str, keys: tuple[str, ...], empty: str | None = None) -> DataFrame:
    """The rows of a table of a version: those of each of its folders, but for the keys that a later folder says are gone."""
    every = folders(at)
    form = _schema(spark, [f"{f}/{table}" for f in every], empty)
    out, later = None, None
    for folder in reversed(every):
        rows = spark.read.schema(form).parquet(f"{folder}/{table}")
        rows = rows if later is None else rows.join(later.select(*[F.col(f"gone_{k}").alias(k) for k in keys]), list(keys), "left_anti").select(*rows.columns)
        out = rows if out is None else out.unionByName(rows)
        if folder != every[0]:
            dropped = spark.read.schema(", ".join(f"gone_{k} string" for k in keys)).parquet(f"{folder}/{gone}")
            later = dropped if later is None else later.union(dropped)
    return out


def write_gone(rows: DataFrame, path: str, name: str, keys: tuple[str, ...]) -> None:
    """Keys that the folders before this one have no longer."""
    rows.select(*[F.col(k).cast("string").alias(f"gone_{k}") for k in keys]).write.mode("overwrite").parquet(f"{path}/{name}")


def write_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")


def read_nodes(spark: SparkSession, at: str) -> DataFrame:
    """Nodes; a metadata-only read is a select, since columns are pruned at the scan."""
    return _live(spark, at, "nodes", "gone_nodes", ("node_id",))


def read_symbols(spark: SparkSession, at: str) -> DataFrame:
    return _live(spark, at, "symbols", "gone_nodes", ("node_id",))


def read_hashes(spark: SparkSession, at: str) -> DataFrame:
    return _live(spark, at, "file_hashes", "gone_files", ("path",))


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Edges, partitioned by type, so that a traversal over some types reads only these."""
    edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def read_edges(spark: SparkSession, at: str) -> DataFrame:
    return _live(spark, at, "edges", "gone_edges", ("source", "target", "type"), "source string, target string, score double, ord bigint, type string")


def edges_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges from JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema.EDGES).option("mode", "FAILFAST").json(path)


def write_index(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, path: str, buckets: int = 64) -> None:
    """Postings in range order of their terms, so that row-group statistics prune to a query's terms, and lengths."""
    R.postings(docs, id_col, text_col).repartitionByRange(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    R.doc_stats(docs, id_col, text_col).write.mode("overwrite").parquet(f"{path}/doc_stats")


def read_index(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of a version; a document that is gone loses both."""
    by_doc = lambda table: _live(spark, at, table, "gone_docs", ("doc_id",))
    return by_doc("postings"), by_doc("doc_stats")


def write_vectors(postings: DataFrame, path: str) -> None:
    """The dense index: hashed vectors of written postings as (doc_id, slot, value), in order of their slots."""
    R.posting_vectors(postings).sortWithinPartitions("slot", "doc_id").write.mode("overwrite").parquet(f"{path}/vectors")


def read_vectors(spark: SparkSession, at: str) -> DataFrame:
    return _live(spark, at, "vectors", "gone_docs", ("doc_id",))


def write_embeddings(vectors: DataFrame, backend: str, path: str) -> None:
    """A dense index of (doc_id, embedding) made by a backend, which is kept as a folder's name."""
    vectors.select("doc_id", "embedding").write.mode("overwrite").parquet(f"{path}/embeddings/backend={backend}")


def read_embeddings(spark: SparkSession, path: str, backend: str) -> DataFrame:
    """The dense index of a backend; another one's vectors are never read as its own."""
    return spark.read.parquet(f"{path}/embeddings").filter(F.col("backend") == backend).drop("backend")


def graphml(files: DataFrame, parts: int | None = None, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """CPG nodes and edges of GraphML documents (ord, content); of a node in several documents the last counts.

    Rows are dealt to `parts` partitions, so that these need not grow with the documents.  Documents that are `apart` have no node or edge
    in common, so that rows stay where their document is.
    """
    facts = list(G.KEYS)
    typed = lambda df, at: df.select("id", *[F.col(f"{at}{c}").alias(c) if c != "line" else F.col(f"{at}line").cast("int").alias("line") for c in facts])
    if apart:
        return typed(G.nodes(files, once=True), ""), G.edges(files, once=True)
    dealt = lambda df, *c: df if parts is None else df.repartition(parts, *c)
    last = dealt(G.nodes(files), "id").groupBy("id").agg(F.max_by(F.struct(*facts), "ord").alias("facts"))
    return typed(last, "facts."), dealt(G.edges(files), "src", "dst", "label").distinct()


def bookmark_search(bookmarks: DataFrame, query: str, k: int) -> DataFrame:
    """(node_id, score): bookmarks (node_id, tag, tag_tokens, content) that have all query words in one field, by BM25 with
    the defaults of full-text tables (k1 1.2, b 0.75), summed over the fields that match."""
    asked = query.lower().split()
    out = None
    for field in ("tag_tokens", "tag", "content"):
        docs = bookmarks.select(F.col("node_id").alias("doc_id"), F.coalesce(F.col(field), F.lit("")).alias("t"))
        words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
        posts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        stats = docs.select("doc_id", F.size(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).cast("bigint").alias("doc_len"))
        q = bookmarks.sparkSession.createDataFrame([(0, t) for t in dict.fromkeys(asked)], "query_id int, term string")
        hits = posts.join(q, "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") == len(set(asked))).select("doc_id")
        scores = R.bm25(q, posts, stats, 1.2, 0.75).join(hits, "doc_id", "left_semi").select("doc_id", "score")
        out = scores if out is None else out.unionByName(scores)
    total = out.groupBy(F.col("doc_id").alias("node_id")).agg(F.round(F.sum("score"), 6).alias("score"))
    return total.orderBy(F.desc("score"), "node_id").limit(k)
