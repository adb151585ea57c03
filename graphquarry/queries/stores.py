"""Queries that write stores into the shared checkpoint folder and read them back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import dense as D
from ..operators import entities as N
from ..operators import retrieval as R
from ..plans import cache, maintain
from ..plans.materialise import ensure_checkpoint_dir
from ..sources import bookmark_index, bookmarks, exports, store
from .registry import model, query, quoted, sql, table
from .retrieval import _BM25, _POST, _TOP, _UNIT, _vectors


def _folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid4().hex}"


def _indexed(spark: SparkSession, sf_dir: str) -> str:
    at = _folder(spark)
    store.write_index(spark, table(spark, sf_dir, "documents"), "doc_id", "text", at)
    return at


@query(f"WITH {_POST} SELECT doc_id, term, tf FROM posts")
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse index of all documents, written and read back."""
    return store.read_index(spark, _indexed(spark, sf_dir))[0].select("doc_id", "term", "tf")


@query(f"WITH {_BM25} {_TOP('sp', schema.TOP_K)}")
def stored_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every benchmark text over the stored index."""
    posts, stats = store.read_index(spark, _indexed(spark, sf_dir))
    return R.top_k(R.bm25(R.query_terms(table(spark, sf_dir, "benchmark"), "item_id"), posts, stats), schema.TOP_K)


@query(f"WITH {_UNIT} {_TOP('de', schema.TOP_K)}")
def stored_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense index with its backend, written and read back, and exact cosine over it."""
    at = _folder(spark)
    store.write_embeddings(_vectors(spark, sf_dir), "table", at)
    v = store.read_embeddings(spark, at, "table")
    return R.top_k(D.best(v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), v, schema.TOP_K), schema.TOP_K)


@query("SELECT node_id, type, path, title FROM nodes")
def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written by type and listed without their content."""
    at = _folder(spark)
    store.write_nodes(model(spark, sf_dir, "nodes"), at)
    return store.read_nodes(spark, at).select("node_id", "type", "path", "title")


@query(f"SELECT source, target, type, ord FROM edges WHERE type IN ({quoted(schema.DIRECTED_TYPES)})")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written by type; only the folders of the types asked for are read."""
    at = _folder(spark)
    store.write_edges(model(spark, sf_dir, "edges"), at)
    return store.read_edges(spark, at).filter(F.col("type").isin(*schema.DIRECTED_TYPES)).select("source", "target", "type", "ord")


_MARKED = "SELECT 'p' || p_partkey AS node_id, lower(p_type) || '-' || p_size AS tag, lower(p_type) || ' ' || p_size AS tag_tokens, p_name AS content FROM part"


@query(f"WITH m AS ({_MARKED}) SELECT node_id, tag, tag_tokens, CASE WHEN p_partkey % 3 = 0 THEN content || ' again' ELSE content END AS content FROM m JOIN part ON node_id = 'p' || p_partkey WHERE p_partkey % 7 <> 0")
def bookmark_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks added, added again with other content, deleted, and listed from the log."""
    at, rows = _folder(spark), sql(spark, sf_dir, _MARKED)
    key = F.substring("node_id", 2, 20).cast("long")
    bookmarks.upsert(rows, at)
    bookmarks.upsert(rows.filter(key % 3 == 0).withColumn("content", F.concat("content", F.lit(" again"))), at)
    bookmarks.delete(rows.filter(key % 7 == 0), at)
    return bookmarks.bookmarks(spark, at)


@query("SELECT count(*) AS bookmarks, count(DISTINCT lower(p_type) || '-' || p_size) AS tags, CAST(sum(length(p_name)) AS BIGINT) AS characters FROM part WHERE p_partkey % 2 = 0")
def bookmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cleared, and the counts of what was added since."""
    at, rows = _folder(spark), sql(spark, sf_dir, _MARKED)
    bookmarks.upsert(rows, at)
    bookmarks.clear(spark, at)
    bookmarks.upsert(rows.filter(F.substring("node_id", 2, 20).cast("long") % 2 == 0), at)
    return bookmarks.stats(spark, at)


_INDEXED = "SELECT 'p' || p_partkey AS node_id, lower(p_type) || '-' || p_size AS tag, lower(p_type) || ' ' || p_size AS tag_tokens, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' economy again' ELSE p_name || ' ' || lower(p_type) END AS content FROM part WHERE p_partkey % 7 <> 0"


@query(
    f"""WITH m AS ({_INDEXED}), f AS (SELECT node_id, 1 AS field, tag_tokens AS t FROM m UNION ALL SELECT node_id, 2, tag FROM m UNION ALL SELECT node_id, 3, content FROM m),
w AS (SELECT node_id, field, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM f), k AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY field),
p AS (SELECT node_id, field, len(w) AS size, q, len(list_filter(w, lambda x: x = q)) AS tf FROM w JOIN (SELECT unnest(['red', 'economy']) AS q) ON list_contains(w, q)), d AS (SELECT field, q, count(*) AS df FROM p GROUP BY field, q),
s AS (SELECT node_id, field, count(*) AS hits, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM p JOIN d USING (field, q) JOIN k USING (field) GROUP BY node_id, field)
SELECT node_id, round(sum(score), 6) AS score FROM s WHERE hits = 2 GROUP BY node_id"""
)
def bookmark_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks found by the kept index after upserts and deletions, from the postings of the query's words alone."""
    at, key = _folder(spark), F.substring("node_id", 2, 20).cast("long")
    rows = sql(spark, sf_dir, _MARKED).withColumn("content", F.concat("content", F.lit(" "), F.regexp_extract("tag", "^(.*)-[^-]*$", 1)))
    bookmark_index.upsert(rows, at)
    bookmark_index.upsert(sql(spark, sf_dir, _MARKED).filter(key % 3 == 0).withColumn("content", F.concat("content", F.lit(" economy again"))), at)
    bookmark_index.delete(rows.filter(key % 7 == 0), at)
    return bookmark_index.search(spark, at, "red economy", 1 << 30)


_SOURCE = "SELECT p_partkey AS k, 'src/' || lower(p_type) || '/m' || p_partkey || '.py' AS path, 'def makePart' || p_partkey || '(x):' || chr(10) || '    return makePart' || (p_partkey + 1) || '(x)' || chr(10) AS content FROM part"


def _history(spark: SparkSession, sf_dir: str) -> str:
    at, rows = _folder(spark), sql(spark, sf_dir, _SOURCE, dealt=True).withColumn("bytes", F.length("content").cast("long"))
    maintain.update(spark, rows.filter("k % 11 <> 0").drop("k"), at, 1)
    changed = F.when(F.col("k") % 50 == 1, F.replace("content", F.lit("return "), F.lit("return 1 + "))).otherwise(F.col("content"))
    maintain.update(spark, rows.filter("k % 13 <> 0").withColumn("content", changed).drop("k"), at, 2)
    return at


@query(
    """SELECT 'v1' AS version_id, count(*) AS node_count, count(*) AS added, CAST(0 AS BIGINT) AS modified, CAST(0 AS BIGINT) AS deleted FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT 'v2', count(*) FILTER (p_partkey % 13 <> 0), count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 11 = 0), count(*) FILTER (p_partkey % 13 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 50 = 1), count(*) FILTER (p_partkey % 13 = 0 AND p_partkey % 11 <> 0) FROM part"""
)
def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store built from code files, brought up to date with changed files, and its versions."""
    return maintain.versions(spark, _history(spark, sf_dir)).select("version_id", "node_count", "added", "modified", "deleted")


@query(
    """SELECT 'src/' || lower(a.p_type) || '/m' || a.p_partkey || '.py' AS source, 'src/' || lower(b.p_type) || '/m' || b.p_partkey || '.py' AS target
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 13 <> 0 AND b.p_partkey % 13 <> 0"""
)
def store_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference edges of that store after its update, by path."""
    at = maintain.generation(spark, _history(spark, sf_dir))
    nodes, edges = store.read_nodes(spark, at), store.read_edges(spark, at).filter("type = 'reference'")
    named = lambda end: nodes.select(F.col("node_id").alias(end), F.col("path").alias(f"{end}_path"))
    return edges.join(named("source"), "source").join(named("target"), "target").select(F.col("source_path").alias("source"), F.col("target_path").alias("target"))


@query("SELECT form, id, label, CASE WHEN form = 'graphml' THEN nullif(name, '') ELSE name END AS name, CASE WHEN form = 'graphml' THEN nullif(code, '') ELSE code END AS code, filename, line FROM cpg_nodes JOIN (SELECT unnest(['graphml', 'graphson', 'neo4jcsv']) AS form) ON true")
def exported_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all parts' programs, exported in three forms and read back."""
    at, nodes, edges = _folder(spark), model(spark, sf_dir, "cpg_nodes"), model(spark, sf_dir, "cpg_edges")
    out = None
    for form in ("graphml", "graphson", "neo4jcsv"):
        exports.write(nodes, edges, at, form)
        rows = exports.read(spark, at, form)[0].select(F.lit(form).alias("form"), "id", "label", "name", "code", "filename", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT form, src, dst, label FROM (SELECT DISTINCT src, dst, label FROM cpg_edges) JOIN (SELECT unnest(['graphml', 'graphson', 'neo4jcsv']) AS form) ON true")
def exported_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of these exports."""
    at, nodes, edges = _folder(spark), model(spark, sf_dir, "cpg_nodes"), model(spark, sf_dir, "cpg_edges")
    out = None
    for form in ("graphml", "graphson", "neo4jcsv"):
        exports.write(nodes, edges, at, form)
        rows = exports.read(spark, at, form)[1].select(F.lit(form).alias("form"), "src", "dst", "label")
        rows = rows if form == "graphml" else rows.distinct()  # GraphML gives each edge once
        out = rows if out is None else out.unionByName(rows)
    return out


_FOUND = "array<struct<name: string, type: string>>"


def _looked(texts: DataFrame) -> DataFrame:
    rows = N.entities_of(texts.select(F.col("hash").alias("node_id"), "content"))
    return rows.groupBy(F.col("node_id").alias("hash")).agg(F.collect_set(F.struct("name", "type")).cast(_FOUND).alias("found"))


@query(
    f"""WITH t AS ({_SOURCE}), o AS (SELECT DISTINCT sha1(content) AS hash FROM t WHERE k % 3 <> 0), n AS (SELECT DISTINCT sha1(CASE WHEN k % 10 = 1 THEN content || 'x = 1' || chr(10) ELSE content END) AS hash FROM t)
SELECT 'first' AS build, count(*) AS asked, CAST(0 AS BIGINT) AS known, count(*) AS looked_through FROM o UNION ALL SELECT 'second', count(*), count(*) FILTER (hash IN (SELECT hash FROM o)), count(*) FILTER (hash NOT IN (SELECT hash FROM o)) FROM n"""
)
def entity_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of two builds that were looked through and those that the cache knew."""
    at = _folder(spark)
    rows = sql(spark, sf_dir, _SOURCE, dealt=True)
    first = rows.filter("k % 3 <> 0").select(F.sha1("content").alias("hash"), "content")
    text = F.when(F.col("k") % 10 == 1, F.concat("content", F.lit("x = 1\n"))).otherwise(F.col("content"))
    uses = [("first", cache.through(first, at, _FOUND, _looked)[1]), ("second", cache.through(rows.select(F.sha1(text).alias("hash"), text.alias("content")), at, _FOUND, _looked)[1])]
    return spark.createDataFrame([(b, u.asked, u.known, u.looked_through) for b, u in uses], "build string, asked bigint, known bigint, looked_through bigint")


@query(f"WITH t AS ({_SOURCE}) SELECT 'makePart' || k AS name, 'definition' AS type, count(*) AS n FROM t GROUP BY k")
def cached_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions read from a cache of two parts after its compaction."""
    at = _folder(spark)
    texts = sql(spark, sf_dir, _SOURCE, dealt=True).select("k", F.sha1("content").alias("hash"), "content")
    for part in (texts.filter("k % 2 = 0"), texts):
        cache.through(part, at, _FOUND, _looked)
    cache.compact(spark, at, _FOUND)
    known, _ = cache.through(texts, at, _FOUND, _looked)
    return texts.join(known, "hash").select(F.inline("found")).filter("type = 'definition'").groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
