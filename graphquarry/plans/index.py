"""Building a store from files: filter, wrap, chunk, nodes, names, symbols, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as K
from ..operators import edges as E
from ..operators import entities as N
from ..sources import files as S
from . import cache

EDGES = ("source", "target", "type", "score", "ord")


def build_nodes(files: DataFrame) -> DataFrame:
    """Nodes of (path, bytes, content) files that the filter keeps, with the names in their text."""
    lang = S.language(F.col("path"))
    kept = files.filter(S.kept(F.col("path"), F.col("bytes")))
    text = F.when(lang.isNotNull(), S.wrapped(F.col("path"), lang, F.col("content"))).otherwise(F.col("content"))
    chunks = K.chunks(kept.select(F.col("path").alias("doc"), T.markdown(text).alias("text")))
    return K.nodes_from_chunks(chunks, F.col("doc")).withColumn("names", T.entities(F.col("content")))


def _kind() -> Column:
    """definition, reference, or call for a reference that a call makes."""
    return F.when(F.col("description").startswith("Code call to "), "call").otherwise(F.col("type"))


def build_symbols(nodes: DataFrame) -> DataFrame:
    """(node_id, name, kind): what the code of nodes with a programming language defines and refers to."""
    code = nodes.filter(S.language(F.col("path")).isNotNull())
    return N.entities_of(code).select("node_id", "name", _kind().alias("kind")).distinct()


def cached_symbols(nodes: DataFrame, path: str) -> DataFrame:
    """build_symbols(), by way of a cache of what was found in a text; nodes have hashes of their content."""
    code = nodes.filter(S.language(F.col("path")).isNotNull())
    form = "array<struct<name: string, type: string>>"

    def look(texts: DataFrame) -> DataFrame:
        rows = N.entities_of(texts.select(F.col("hash").alias("node_id"), "content"))
        return rows.groupBy(F.col("node_id").alias("hash")).agg(F.collect_set(F.struct("name", _kind().alias("type"))).cast(form).alias("found"))

    known, _ = cache.through(code.select("hash", "content"), path, form, look)
    return code.select("node_id", "hash").join(known, "hash").select("node_id", F.inline("found")).select("node_id", "name", F.col("type").alias("kind")).distinct()


def semantic_edges(nodes: DataFrame, threshold: float = 0.2, sources: DataFrame | None = None) -> DataFrame:
    """Edges between nodes that share names."""
    found = E.jaccard_edges(nodes.select("node_id", F.explode("names").alias("name")), threshold, sources=sources)
    return found.select("source", "target", F.lit("semantic").alias("type"), "score", F.lit(0).cast("bigint").alias("ord"))


def symbol_edges(symbols: DataFrame, noise: tuple[str, ...] = (), touching: DataFrame | None = None) -> DataFrame:
    """Reference edges from the users of a symbol to its definitions, and call edges from the code that calls it, found together; with
    `touching` (node_id), those with an end among them."""
    found = E.symbol_uses(symbols, noise).groupBy("source", "target").agg(F.bool_or("called").alias("called"))
    if touching is not None:
        near = touching.distinct()
        for end in ("source", "target"):
            found = found.join(near.select(F.col("node_id").alias(end), F.lit(True).alias(f"near_{end}")), end, "left")
        found = found.filter("near_source OR near_target")
    types = F.when(F.col("called"), F.array(F.lit("reference"), F.lit("call"))).otherwise(F.array(F.lit("reference")))
    return found.select("source", "target", F.explode(types).alias("type"), F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("ord"))


def build_edges(
    nodes: DataFrame, threshold: float = 0.2, symbols: DataFrame | None = None, noise: tuple[str, ...] = (), more: DataFrame | None = None, sources: DataFrame | None = None, touching: DataFrame | None = None
) -> DataFrame:
    """All families: semantic, reference and call edges, and those of other builders (`more`: data flow, claims,
    conversations; columns EDGES) whose ends are nodes and differ.

    With `sources` (node_id) only the semantic edges of these, with `touching` (node_id) only the others that have an end among them.
    """
    symbols = build_symbols(nodes) if symbols is None else symbols
    out = semantic_edges(nodes, threshold, sources).unionByName(symbol_edges(symbols, noise, touching))
    if more is None:
        return out
    own = E.valid(more, nodes).select(*EDGES)
    if touching is not None:
        near = lambda end: own.join(touching.withColumnRenamed("node_id", end), end, "left_semi").select(*EDGES)
        own = near("source").union(near("target")).distinct()
    return out.unionByName(own)
