"""Queries that put the pieces together: retrieval with expansion, centrality, packing, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import context as C
from ..operators import edges as E
from ..operators import paths as P
from ..operators import retrieval as R
from ..plans import query as Q
from ..plans.materialise import cut
from .registry import query, sql, table
from .retrieval import _BM25, _TOP

_E = lambda s: f"CAST({s} AS DOUBLE)"
#: A graph over documents by their ids.
DOC_EDGES = f"""SELECT doc_id AS source, doc_id + 20 AS target, 'reference' AS type, {_E("0.5 + (doc_id % 5) * 0.1")} AS score, doc_id * 10 AS ord FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, doc_id + 7, 'semantic', {_E("0.3 + (doc_id % 7) * 0.1")}, doc_id * 10 + 1 FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, doc_id + 1, 'supersedes', {_E("1.0")}, doc_id * 10 + 2 FROM documents WHERE doc_id % 40 = 0"""
_LIVE = f"de AS ({DOC_EDGES}), lv AS (SELECT * FROM de WHERE source NOT IN (SELECT target FROM de WHERE type = 'supersedes')), st AS (SELECT source AS src, target AS dst FROM lv WHERE type NOT IN ('supersedes', 'contradicts') UNION SELECT target, source FROM lv WHERE type = 'semantic')"
_SUB = f"""WITH RECURSIVE {_BM25}, se AS ({_TOP('sp', 5)}), {_LIVE}, re(query_id, node, depth) AS (SELECT query_id, doc_id, 0 FROM se UNION SELECT query_id, dst, depth + 1 FROM re JOIN st ON src = node WHERE depth < 2),
mi AS (SELECT query_id, node, CAST(min(depth) AS INT) AS depth FROM re GROUP BY query_id, node), sb AS (SELECT query_id, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node) AS r FROM mi) WHERE r <= {schema.NODE_CAP})"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id")
    return cut(R.top_k(R.bm25(terms, R.postings(docs, "doc_id", "text", terms), R.doc_stats(docs, "doc_id", "text")), 5))


def _subgraphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seeds = _seeds(spark, sf_dir)
    return seeds, cut(Q.subgraphs(seeds, sql(spark, sf_dir, DOC_EDGES), 2))


@query(f"{_SUB} SELECT query_id, node, depth FROM sb")
def expanded_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with what they reach, capped by id."""
    return _subgraphs(spark, sf_dir)[1]


@query(f"{_SUB} SELECT query_id, node, d.source, d.lang, d.n_chars FROM sb JOIN documents d ON d.doc_id = node")
def loaded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the subgraphs, loaded by a join on their ids."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), "source", "lang", "n_chars")
    return _subgraphs(spark, sf_dir)[1].join(docs, "node").select("query_id", "node", "source", "lang", "n_chars")


@query(f"{_SUB} SELECT a.query_id, de.source, de.target, de.type, de.ord FROM de JOIN sb a ON a.node = de.source JOIN sb b ON b.node = de.target AND b.query_id = a.query_id")
def query_subgraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Induced edges of each query's subgraph."""
    return Q.induced(_subgraphs(spark, sf_dir)[1], sql(spark, sf_dir, DOC_EDGES)).select("query_id", "source", "target", "type", "ord")


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seeds, sub = _subgraphs(spark, sf_dir)
    own = cut(Q.induced(sub, sql(spark, sf_dir, DOC_EDGES)))
    a, b = F.least("source", "target").cast("string"), F.greatest("source", "target").cast("string")
    last = own.filter("source <> target").groupBy("query_id", a.alias("a"), b.alias("b")).agg(F.max(F.struct("ord", "score", "type")).alias("e"))
    return seeds, own, last.select("query_id", "a", "b", (F.col("e.score") * F.when(F.col("e.type") == "reference", 2.0).otherwise(1.0)).alias("weight"), F.col("e.score").alias("score"), F.col("e.type").alias("label"))


@query()
def centralities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centralities of each query's subgraph."""
    out = C.centrality(_pairs(spark, sf_dir)[2])
    return out.select("query_id", "node", *[F.round(c, 6).alias(c) for c in ("betweenness", "degree", "closeness", "eigenvector", "composite")])


@query(
    f"""{_SUB}, pr AS (SELECT DISTINCT a.query_id, least(de.source, de.target) AS x, greatest(de.source, de.target) AS y FROM de JOIN sb a ON a.node = de.source JOIN sb b ON b.node = de.target AND b.query_id = a.query_id),
al AS (SELECT query_id, x AS v, y AS w FROM pr UNION SELECT query_id, y, x FROM pr), rc(query_id, v, root) AS (SELECT query_id, v, v FROM al UNION SELECT rc.query_id, al.w, rc.root FROM rc JOIN al ON al.query_id = rc.query_id AND al.v = rc.v),
co AS (SELECT query_id, v, min(root) AS c FROM rc GROUP BY query_id, v), sz AS (SELECT query_id, c, count(*) AS n FROM co GROUP BY query_id, c), dg AS (SELECT query_id, v, count(*) AS d FROM al GROUP BY query_id, v)
SELECT query_id, CAST(v AS VARCHAR) AS node, round(d / (n - 1), 6) AS degree FROM co JOIN sz USING (query_id, c) JOIN dg USING (query_id, v)"""
)
def query_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree part of the centralities, which SQL can check."""
    return C.centrality(_pairs(spark, sf_dir)[2]).select("query_id", "node", F.round("degree", 6).alias("degree"))


@query()
def path_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the paths from the seeds."""
    seeds, own, _ = _pairs(spark, sf_dir)
    first = seeds.select("query_id", F.col("doc_id").cast("string").alias("node"))
    text = own.select("query_id", F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "type")
    return C.qualities(first, text).withColumn("quality", F.round("quality", 6))


_PAIRS = f"""{_SUB}, own AS (SELECT a.query_id, CAST(de.source AS VARCHAR) AS source, CAST(de.target AS VARCHAR) AS target, de.type, de.score, de.ord FROM de JOIN sb a ON a.node = de.source JOIN sb b ON b.node = de.target AND b.query_id = a.query_id WHERE de.source <> de.target),
pw AS (SELECT query_id, least(source, target) AS a, greatest(source, target) AS b, arg_max(score, ord) AS score, arg_max(type, ord) AS label FROM own GROUP BY ALL), st2 AS (SELECT query_id, a AS src, b AS dst, score, label, score * CASE WHEN label = 'reference' THEN 2 ELSE 1 END AS w FROM pw UNION ALL SELECT query_id, b, a, score, label, score * CASE WHEN label = 'reference' THEN 2 ELSE 1 END FROM pw),
dd(h, query_id, seed, node, x) AS (SELECT DISTINCT 0, query_id, CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), CAST(0 AS DOUBLE) FROM se JOIN st2 USING (query_id) WHERE src = CAST(doc_id AS VARCHAR) UNION ALL SELECT h + 1, dd.query_id, seed, dst, min(x + w) FROM dd JOIN st2 ON st2.query_id = dd.query_id AND src = node WHERE h < 24 GROUP BY h, dd.query_id, seed, dst),
be AS (SELECT query_id, seed, node, min(x) AS x FROM dd GROUP BY query_id, seed, node)"""


@query(f"{_PAIRS} SELECT query_id, seed, node, round(x, 6) AS distance FROM be")
def seed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every node of each query's subgraph from each seed."""
    seeds, _, pairs = _pairs(spark, sf_dir)
    ends = pairs.select("query_id", F.col("a").alias("node")).union(pairs.select("query_id", "b")).distinct()
    first = cut(seeds.select("query_id", F.col("doc_id").cast("string").alias("node")).join(ends, ["query_id", "node"], "left_semi"))
    return P.distances(first, pairs).withColumn("distance", F.round("distance", 6))


_ALL = _PAIRS.replace("FROM se JOIN st2 USING (query_id) WHERE src = CAST(doc_id AS VARCHAR)", "FROM (SELECT DISTINCT query_id, src AS doc_id FROM st2) every_node")


@query(f"{_ALL} SELECT query_id, node, round((n - 1) / total, 6) AS closeness FROM (SELECT query_id, seed AS node, count(*) AS n, sum(x) AS total FROM be GROUP BY query_id, seed)")
def closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness of all nodes of each query's subgraph within their component, from distances of all of them at once."""
    pairs = _pairs(spark, sf_dir)[2]
    ends = cut(pairs.select("query_id", F.col("a").alias("node")).union(pairs.select("query_id", "b")).distinct())
    return P.closeness(ends, pairs).withColumn("closeness", F.round("closeness", 6))


@query(
    f"""{_PAIRS}, bp AS (SELECT v.query_id, v.seed, v.node, min(u.node) AS before FROM be v JOIN st2 ON st2.query_id = v.query_id AND st2.dst = v.node JOIN be u ON u.query_id = v.query_id AND u.seed = v.seed AND u.node = st2.src WHERE abs(u.x + st2.w - v.x) <= 1e-9 AND u.x < v.x GROUP BY ALL),
ti AS (SELECT CAST(doc_id AS VARCHAR) AS node, source || '/' || doc_id AS title FROM documents),
ro(query_id, seed, node, path, score, told) AS (SELECT query_id, seed, be.node, [be.node], CAST(0 AS DOUBLE), title FROM be JOIN ti ON ti.node = be.node WHERE seed = be.node UNION ALL
SELECT ro.query_id, ro.seed, bp.node, list_append(path, bp.node), ro.score + st2.score, told || ' → ' || title || ' [' || st2.label || ']' FROM ro JOIN bp ON bp.query_id = ro.query_id AND bp.seed = ro.seed AND bp.before = ro.node JOIN st2 ON st2.query_id = ro.query_id AND st2.src = ro.node AND st2.dst = bp.node JOIN ti ON ti.node = bp.node),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS rank FROM ro WHERE len(path) > 1)
SELECT query_id, CAST(rank AS INT) AS rank, array_to_string(path, '>') AS path, round(score, 6) AS score, told AS narrative FROM rk WHERE rank <= 5"""
)
def reasoning_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best shortest paths from the seeds, told as text."""
    seeds, _, pairs = _pairs(spark, sf_dir)
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("title"))
    first = cut(seeds.select("query_id", F.col("doc_id").cast("string").alias("node")))
    return P.best_routes(first, pairs, titles).select("query_id", "rank", F.array_join("path", ">").alias("path"), F.round("score", 6).alias("score"), "narrative")


_BLOCKS = "SELECT CAST(o_custkey % 20 AS BIGINT) AS query_id, 'o' || o_orderkey AS node_id, 'f' || (o_orderkey % 37) AS path, CAST(o_totalprice % 1000 AS DOUBLE) / 1000 AS importance, CAST(o_orderkey % 400 + 3 AS INT) AS tokens, CASE o_orderkey % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'text' WHEN 2 THEN 'readme' ELSE 'config' END AS role FROM orders"


@query()
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed greedily into a token budget."""
    return C.packed(sql(spark, sf_dir, _BLOCKS), 5000)


@query(f"WITH b AS ({_BLOCKS}) SELECT query_id, node_id, CAST(upto AS BIGINT) AS upto FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY importance DESC, node_id) AS upto FROM b) WHERE upto <= 5000")
def prefix_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of the ranking that fits a budget."""
    return C.prefix_packed(sql(spark, sf_dir, _BLOCKS), 5000)


@query()
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 to R5 in one: the packed context of every benchmark text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("text").alias("type"), (F.col("n_chars") / 4).cast("int").alias("token_count"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return Q.answer(queries, docs, sql(spark, sf_dir, DOC_EDGES), k=5, hops=2, budget=4000)


_WEIGH = "SELECT doc_id AS node, CAST(doc_id % 10 AS DOUBLE) / 10 AS similarity, CAST(doc_id % 7 AS DOUBLE) / 10 AS centrality, doc_id % 4 = 0 AS is_seed FROM documents"


@query(f"WITH w AS ({_WEIGH}) SELECT node, round(0.6 * similarity + 0.3 * centrality + CASE WHEN is_seed THEN 0.1 ELSE 0 END, 6) AS importance FROM w")
def node_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of nodes to an answer."""
    score = schema.ALPHA * F.col("similarity") + schema.BETA * F.col("centrality") + F.when(F.col("is_seed"), schema.GAMMA).otherwise(0.0)
    return sql(spark, sf_dir, _WEIGH).select("node", R.rounded(score).alias("importance"))


_QUOTED = "SELECT doc_id AS answer_id, 'As stated, \"' || substr(text, 3, 30) || '\" and \"short\".' AS response FROM documents WHERE doc_id % 100 = 0 AND length(text) > 40"


@query(
    f"""WITH q AS ({_QUOTED}), x AS (SELECT answer_id, unnest(regexp_extract_all(response, '"([^"]{{20,}})"', 1)) AS quote FROM q)
SELECT answer_id, quote, count(*) AS n FROM x JOIN documents d ON contains(d.text, quote) GROUP BY answer_id, quote"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted spans of every hundredth document's answer, found in all documents."""
    quotes = sql(spark, sf_dir, _QUOTED).select("answer_id", F.explode(F.regexp_extract_all("response", F.lit('"([^"]{20,})"'), F.lit(1))).alias("quote"))
    found = E.quoted_in(quotes.select("quote").distinct(), table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quotes.join(found, "quote").select("answer_id", "quote", "n")
