"""Incremental maintenance and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status): added, modified, deleted or unchanged, by a full outer join on the path."""
    a, b = old.select("path", F.col("hash").alias("h0")), new.select("path", F.col("hash").alias("h1"))
    status = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified").otherwise("unchanged")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def up_to_date(old: DataFrame, new: DataFrame, finalized: bool) -> DataFrame:
    """One row: whether indexing can be skipped."""
    changed = file_diff(old, new).filter("status <> 'unchanged'").agg(F.count(F.lit(1)).alias("changed"))
    return changed.select("changed", ((F.col("changed") == 0) & F.lit(finalized)).alias("skip"))


def gc_plan(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, reason): duplicates of a hash (the least id stays), then nodes of paths that are gone; bookmarks stay."""
    own = nodes.filter("type <> 'tagged_snippet'")
    first = own.groupBy("hash").agg(F.min("node_id").alias("keep"))
    marked = own.join(first, "hash")
    twice = marked.filter("node_id <> keep").select("node_id", F.lit("duplicate").alias("reason"))
    gone = marked.filter("node_id = keep").join(files.select("path"), "path", "left_anti").select("node_id", F.lit("orphan").alias("reason"))
    return twice.unionByName(gone)


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(hash, status): added, deleted or unchanged nodes by content hash."""
    a, b = old.select("hash").distinct().withColumn("o", F.lit(1)), new.select("hash").distinct().withColumn("n", F.lit(1))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").otherwise("unchanged")
    return a.join(b, "hash", "full_outer").select("hash", status.alias("status"))


def affected(delta: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id): changed nodes and their neighbours."""
    changed = nodes.join(delta.filter("status = 'added'"), "hash", "left_semi").select("node_id")
    out = edges.join(changed.withColumnRenamed("node_id", "source"), "source", "left_semi").select(F.col("target").alias("node_id"))
    into = edges.join(changed.withColumnRenamed("node_id", "target"), "target", "left_semi").select(F.col("source").alias("node_id"))
    return changed.union(out).union(into).distinct()


def reused_ids(new: DataFrame, old: DataFrame) -> DataFrame:
    """new nodes with the id that an old node of the same hash has."""
    known = old.groupBy("hash").agg(F.min("node_id").alias("old_id"))
    return new.join(known, "hash", "left").select(F.coalesce("old_id", "node_id").alias("node_id"), "hash", F.col("old_id").isNotNull().alias("reused"))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows with new ones in place of those of the same key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def cache_probe(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached entities, misses) of chunks by hash."""
    return chunks.join(cache, "hash"), chunks.join(cache, "hash", "left_anti")


def history(versions: DataFrame, limit: int = 50) -> DataFrame:
    """Versions newest first."""
    return versions.orderBy(F.desc("ts"), F.desc("version_id")).limit(limit)


def chain(versions: DataFrame) -> DataFrame:
    """versions with previous_version_id and the changes since it.  Versions are few; they are ordered in one task."""
    order = W.orderBy("ts", "version_id")
    return versions.select("*", F.lag("version_id").over(order).alias("previous_version_id"), (F.col("node_count") - F.lag("node_count").over(order)).alias("node_change"))


def version_diff(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (v1, v2) with the differences in time and counts, and what they amount to."""
    a, b = (versions.select(F.col("version_id").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("ts", "node_count", "edge_count")]) for i in (1, 2))
    both = pairs.join(a, "v1").join(b, "v2").select("v1", "v2", (F.col("ts2") - F.col("ts1")).alias("seconds"), (F.col("node_count2") - F.col("node_count1")).alias("nodes"), (F.col("edge_count2") - F.col("edge_count1")).alias("edges"))

    def said(c: str) -> object:
        n = F.col(c)
        return F.when(n > 0, F.format_string(f"Added %,d {c}", n)).when(n < 0, F.format_string(f"Removed %,d {c}", -n))

    hours = F.col("seconds") / 3600
    age = F.when(hours < 1, F.format_string("Updated %d minutes ago", (hours * 60).cast("int"))).when(hours < 24, F.format_string("Updated %d hours ago", hours.cast("int"))).otherwise(F.format_string("Updated %d days ago", (hours / 24).cast("int")))
    return both.withColumn("summary", F.concat_ws("; ", said("nodes"), said("edges"), age))


def rollback_targets(versions: DataFrame, current: str) -> DataFrame:
    """versions that `current` can go back to: those with a lower number."""
    number = F.regexp_extract("version_id", r"\d+", 0).cast("int")
    at = F.regexp_extract(F.lit(current), r"\d+", 0).cast("int")
    return versions.filter(number < at)


def manifest_hash(files: DataFrame) -> DataFrame:
    """One row: 16 characters of the sha256 over per-file hashes, combined without an order or a single task.

    Each file's sha256 gives two 15-digit numbers; their sums are hashed, so tasks add up partial sums only.
    """
    h = F.sha2(F.concat_ws("\0", "path", "hash"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)"))
    sums = files.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(13).alias("b"))
    return sums.select("n", F.substring(F.sha2(F.concat_ws("-", "n", F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 16).alias("hash"))
