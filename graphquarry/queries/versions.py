"""Incremental maintenance and version queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions as V
from .registry import model, query, sql, table

_DIFF = "SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS status FROM files_old o FULL JOIN files_new n ON o.path = n.path"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return model(spark, sf_dir, "files_old"), model(spark, sf_dir, "files_new")


@query(_DIFF)
def file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, modified, deleted, unchanged."""
    return V.file_diff(*_files(spark, sf_dir))


@query("SELECT path FROM files_old EXCEPT SELECT path FROM files_new")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference of paths."""
    old, new = _files(spark, sf_dir)
    return old.select("path").subtract(new.select("path"))


@query(f"SELECT count(*) AS changed, count(*) = 0 AS skip FROM ({_DIFF}) WHERE status <> 'unchanged'")
def skip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: whether indexing can be skipped."""
    return V.up_to_date(*_files(spark, sf_dir), finalized=True)


_NODES = "SELECT 'd' || doc_id AS node_id, md5(text) AS hash, source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 50 = 0 THEN 'tagged_snippet' ELSE 'text' END AS type FROM documents"


@query(
    f"""WITH n AS (SELECT * FROM ({_NODES}) WHERE type <> 'tagged_snippet'), k AS (SELECT hash, min(node_id) AS keep FROM n GROUP BY hash)
SELECT node_id, 'duplicate' AS reason FROM n JOIN k USING (hash) WHERE node_id <> keep UNION ALL SELECT node_id, 'orphan' FROM n JOIN k USING (hash) WHERE node_id = keep AND path NOT IN (SELECT path FROM files_new)"""
)
def gc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates and orphans to remove."""
    return V.gc_plan(sql(spark, sf_dir, _NODES), model(spark, sf_dir, "files_new"))


_DELTA = "SELECT coalesce(o.hash, n.hash) AS hash, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' ELSE 'unchanged' END AS status FROM (SELECT DISTINCT hash FROM files_old) o FULL JOIN (SELECT DISTINCT hash FROM files_new) n ON o.hash = n.hash"


@query(_DELTA)
def delta_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, deleted or unchanged by hash."""
    return V.node_delta(*_files(spark, sf_dir))


_NEW_NODES = "SELECT path AS node_id, hash FROM files_new"
_LINKS = "SELECT a.path AS source, b.path AS target FROM files_new a JOIN files_new b ON replace(a.path, '7.md', '8.md') = b.path WHERE a.path LIKE '%7.md'"


@query(f"WITH d AS ({_DELTA}), n AS ({_NEW_NODES}), e AS ({_LINKS}), c AS (SELECT node_id FROM n WHERE hash IN (SELECT hash FROM d WHERE status = 'added')) SELECT node_id FROM c UNION SELECT target FROM e WHERE source IN (SELECT node_id FROM c) UNION SELECT source FROM e WHERE target IN (SELECT node_id FROM c)")
def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: changed nodes and their neighbours."""
    delta = V.node_delta(*_files(spark, sf_dir))
    return V.affected(delta, sql(spark, sf_dir, _NEW_NODES), sql(spark, sf_dir, _LINKS))


@query(f"WITH n AS ({_NEW_NODES}), k AS (SELECT hash, min(path) AS old_id FROM files_old GROUP BY hash) SELECT coalesce('old ' || old_id, node_id) AS node_id, hash, old_id IS NOT NULL AS reused FROM n LEFT JOIN k USING (hash)")
def reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New nodes keep the id of old ones with the same content."""
    old = model(spark, sf_dir, "files_old").select(F.concat(F.lit("old "), "path").alias("node_id"), "hash")
    return V.reused_ids(sql(spark, sf_dir, _NEW_NODES), old)


@query("SELECT path, hash FROM files_old WHERE path NOT IN (SELECT path FROM files_new) UNION ALL SELECT path, hash FROM files_new")
def upsert_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key."""
    old, new = _files(spark, sf_dir)
    return V.upsert(old, new, "path")


@query("SELECT n.path, o.path IS NOT NULL AS hit FROM files_new n LEFT JOIN (SELECT hash, min(path) AS path FROM files_old GROUP BY hash) o ON o.hash = n.hash")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks found in the entity cache, and misses."""
    old, new = _files(spark, sf_dir)
    hits, misses = V.cache_probe(new, old.select("hash").distinct())
    return hits.select("path", F.lit(True).alias("hit")).union(misses.select("path", F.lit(False)))


@query("SELECT version_id, ts, node_count, edge_count FROM versions ORDER BY ts DESC LIMIT 10")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest versions."""
    return V.history(model(spark, sf_dir, "versions"), 10)


@query("SELECT version_id, lag(version_id) OVER (ORDER BY ts) AS previous_version_id, node_count - lag(node_count) OVER (ORDER BY ts) AS node_change FROM versions")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their predecessors."""
    return V.chain(model(spark, sf_dir, "versions")).select("version_id", "previous_version_id", "node_change")


_PAIRS = "SELECT a.version_id AS v1, b.version_id AS v2 FROM versions a JOIN versions b ON b.ts = a.ts + 172800 OR b.ts = a.ts - 86400"


@query(
    f"""WITH pr AS ({_PAIRS}), d AS (SELECT v1, v2, b.ts - a.ts AS seconds, b.node_count - a.node_count AS nodes, b.edge_count - a.edge_count AS edges FROM pr JOIN versions a ON a.version_id = v1 JOIN versions b ON b.version_id = v2)
SELECT *, concat_ws('; ', CASE WHEN nodes > 0 THEN format('Added {{:,d}} nodes', nodes) WHEN nodes < 0 THEN format('Removed {{:,d}} nodes', -nodes) END, CASE WHEN edges > 0 THEN format('Added {{:,d}} edges', edges) WHEN edges < 0 THEN format('Removed {{:,d}} edges', -edges) END,
CASE WHEN seconds < 3600 THEN 'Updated ' || CAST(trunc(seconds / 60) AS INT) || ' minutes ago' WHEN seconds < 86400 THEN 'Updated ' || CAST(trunc(seconds / 3600) AS INT) || ' hours ago' ELSE 'Updated ' || CAST(trunc(seconds / 86400) AS INT) || ' days ago' END) AS summary FROM d"""
)
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of version pairs."""
    return V.version_diff(model(spark, sf_dir, "versions"), sql(spark, sf_dir, _PAIRS))


@query("SELECT version_id FROM versions WHERE CAST(regexp_extract(version_id, '\\d+') AS INT) < 12")
def rollback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that version 12 can go back to."""
    return V.rollback_targets(model(spark, sf_dir, "versions"), "v12").select("version_id")


@query(
    """WITH h AS (SELECT sha256(path || chr(0) || hash) AS h FROM files_new), s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b FROM h)
SELECT n, substr(sha256(n || '-' || a || '-' || b), 1, 16) AS hash FROM s"""
)
def manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a file list."""
    return V.manifest_hash(model(spark, sf_dir, "files_new"))


@query("SELECT count(*) AS nodes, CAST(sum(token_count) AS BIGINT) AS tokens, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT path) FROM nodes) AS files FROM nodes")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a store as one row."""
    n = model(spark, sf_dir, "nodes").agg(F.count(F.lit(1)).alias("nodes"), F.sum("token_count").alias("tokens"), F.count_distinct("path").alias("files"), F.lit(1).alias("one"))
    e = model(spark, sf_dir, "edges").agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("one"))
    return n.join(e, "one").select("nodes", "tokens", "edges", "files")


@query("SELECT count(*) FILTER (n >= 1) AS languages, CAST(sum(n) AS BIGINT) AS files, sum(n) >= 50 OR count(*) >= 3 AS parallel FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def parallel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a build is worth splitting."""
    by = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count_if(F.col("n") >= 1).alias("languages"), F.sum("n").alias("files"), ((F.sum("n") >= 50) | (F.count(F.lit(1)) >= 3)).alias("parallel"))
