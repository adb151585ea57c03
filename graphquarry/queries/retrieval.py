"""Retrieval queries: postings, BM25, vectors, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions import words
from ..operators import dense as D
from ..operators import edges as E
from ..operators import retrieval as R
from ..plans.materialise import cut
from .registry import literal, model, query, quoted, sql, table

_TOK = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({quoted(words.STOP_WORDS)}))"
_POST = f"""toks AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents),
posts AS (SELECT doc_id, term, CAST(count(*) AS INT) AS tf FROM toks GROUP BY doc_id, term),
stats AS (SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS doc_len FROM documents),
corpus AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM stats)"""
_BM25 = f"""{_POST},
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
sp AS (SELECT query_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * {schema.BM25_K1 + 1} / (tf + {schema.BM25_K1} * (1 - {schema.BM25_B} + {schema.BM25_B} * doc_len / avgdl))) AS score
  FROM qt JOIN posts USING (term) JOIN df USING (term) JOIN stats USING (doc_id), corpus GROUP BY query_id, doc_id)"""
_TOP = lambda src, k, key="doc_id": f"SELECT query_id, {key}, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, {key}, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {key}) AS rank FROM {src}) WHERE rank <= {k}"
_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
de AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_cosine_similarity(a.e, b.e) AS score FROM u a, u b WHERE a.vec_id % 100 = 0)"""


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    terms = R.query_terms(table(spark, sf_dir, "benchmark"), "item_id")
    return R.bm25(terms, R.postings(docs, "doc_id", "text", terms), R.doc_stats(docs, "doc_id", "text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return D.best(v.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding"), v, schema.TOP_K)


@query(f"WITH {_POST} SELECT doc_id, term, tf FROM posts")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequencies of all documents."""
    return R.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_POST} SELECT s.doc_id, doc_len, n AS n_docs, round(avgdl, 6) AS avgdl FROM stats s, corpus")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: lengths, number and mean length of documents."""
    stats = R.doc_stats(table(spark, sf_dir, "documents"), "doc_id", "text")
    corpus = R.corpus_stats(stats).first()
    return stats.withColumns({"n_docs": F.lit(corpus.n_docs).cast("long"), "avgdl": F.round(F.lit(corpus.avgdl), 6)})


@query(f"WITH {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM posts GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: document and collection frequency of each term."""
    return R.postings(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_BM25} {_TOP('sp', schema.TOP_K)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every benchmark text over all documents."""
    return R.top_k(_sparse(spark, sf_dir), schema.TOP_K)


@query(f"WITH {_UNIT} {_TOP('de', schema.TOP_K)}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine of every hundredth vector with all vectors."""
    return R.top_k(_dense(spark, sf_dir), schema.TOP_K)


_FUSE = f"""{_BM25}, {_UNIT},
s1 AS ({_TOP("sp", schema.TOP_K)}), d1 AS ({_TOP("de2", 3 * schema.TOP_K)}),
s2 AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM s1 WINDOW w AS (PARTITION BY query_id)),
d2 AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM d1 WINDOW w AS (PARTITION BY query_id)),
fu AS (SELECT query_id, doc_id, {1 - schema.DENSE_WEIGHT} * coalesce(s, 0) + {schema.DENSE_WEIGHT} * coalesce(d, 0) AS score FROM s2 FULL JOIN d2 USING (query_id, doc_id))""".replace("FROM u a, u b WHERE a.vec_id % 100 = 0)", "FROM u a, u b WHERE a.vec_id IN (SELECT item_id FROM benchmark)), de2 AS (SELECT * FROM de)")


def _fusable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The benchmark texts' BM25 lists, and the best vectors for each by the one whose id is the item's."""
    v = _vectors(spark, sf_dir)
    return _sparse(spark, sf_dir), D.best(v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "embedding"), v, 3 * schema.TOP_K)


@query(f"WITH {_FUSE} {_TOP('fu', schema.TOP_K)}")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused sparse and dense lists."""
    return R.hybrid(*_fusable(spark, sf_dir))


@query(f"WITH {_FUSE} SELECT query_id, doc_id, round(score, 6) AS score FROM fu")
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole fused lists."""
    sparse, dense = _fusable(spark, sf_dir)
    cols = ("query_id", "doc_id", "score")
    return R.fuse(R.top_k(sparse, schema.TOP_K).select(*cols), R.top_k(dense, 3 * schema.TOP_K).select(*cols)).withColumn("score", R.rounded(F.col("score")))


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-hashed vectors of all documents."""
    return R.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("value", R.rounded(F.col("value")))


_SCORED = """SELECT n.node_id, n.path, n.type, n.token_count, CAST(abs(length(n.content) * 37 % 101) AS DOUBLE) / 100 AS similarity, CAST(length(n.path) * 13 % 97 AS DOUBLE) / 100 AS centrality,
length(n.path) % 5 = 0 AS is_seed, CAST(length(n.path) % 11 AS DOUBLE) / 10 AS path_quality, CASE length(n.content) % 3 WHEN 0 THEN 'readme orders' WHEN 1 THEN 'tsconfig' ELSE 'src/economy' END AS query_text,
CASE length(n.path) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS grounded FROM nodes n"""


def _multiplier(path: str) -> str:
    name = f"list_extract(string_split(lower({path}), '/'), -1)"
    extension = f"(CASE WHEN contains({name}, '.') THEN '.' || list_extract(string_split({name}, '.'), -1) ELSE '' END)"
    return f"(CASE WHEN {name} IN ({quoted(words.META_NAMES)}) THEN 0.3 WHEN {extension} IN ({quoted(words.CONFIG_EXTENSIONS)}) OR {name} IN ({quoted(words.CONFIG_NAMES)}) THEN 0.4 WHEN {extension} IN ({quoted(words.CODE_EXTENSIONS)}) THEN 1.3 ELSE 1.0 END)"


_ROLE = "(CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.ROLE_WEIGHTS.items()) + f" ELSE {schema.DEFAULT_ROLE_WEIGHT} END)"
_LONG = "list_filter(string_split_regex(trim(lower(query_text)), '\\s+'), lambda w: length(w) > 3)"
_BOOST = f"""(CASE WHEN contains(lower(path), trim(lower(query_text))) THEN 0.30
WHEN len({_LONG}) >= 2 AND list_has_all(string_split_regex(regexp_replace(lower(path), '[/.\\\\-]', ' ', 'g'), '\\s+'), {_LONG}) THEN 0.20
WHEN len({_LONG}) = 1 AND contains(regexp_replace(lower(path), '[/.\\-_]', '', 'g'), list_extract({_LONG}, 1)) THEN 0.25 ELSE 0.0 END)"""


@query(
    f"""WITH sc AS ({_SCORED}),
x AS (SELECT *, ((0.51 * similarity + 0.255 * centrality + 0.1 * CAST(is_seed AS INT) + 0.15 * path_quality) * {_ROLE} * {_multiplier("path")} + {_BOOST}) * (1 - 0.1 * least(token_count, 1000) / 1000) AS v FROM sc)
SELECT node_id, round(CAST(least(CASE WHEN grounded THEN v * 1.2 WHEN NOT grounded THEN v * 0.5 ELSE v END, 1.0) AS DOUBLE), 6) AS importance FROM x"""
)
def importance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every node."""
    scored = sql(spark, sf_dir, _SCORED)
    return scored.select("node_id", R.rounded(R.importance(scored)).alias("importance"))


@query(f"SELECT node_id, CAST({_multiplier('path')} AS DOUBLE) AS multiplier, CAST({_ROLE} AS DOUBLE) AS role_weight FROM nodes")
def file_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-type multiplier and role weight."""
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in schema.ROLE_WEIGHTS.items() for x in kv])[F.col("type")], F.lit(schema.DEFAULT_ROLE_WEIGHT))
    return model(spark, sf_dir, "nodes").select("node_id", T.file_type_multiplier(F.col("path")).alias("multiplier"), role.alias("role_weight"))


@query(f"WITH sc AS ({_SCORED}) SELECT node_id, CAST({_BOOST} AS DOUBLE) AS boost FROM sc")
def query_path_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost of nodes whose path matches the query."""
    return sql(spark, sf_dir, _SCORED).select("node_id", T.query_path_boost(F.col("query_text"), F.col("path")).alias("boost"))


_PRE = "similarity + centrality + CAST(is_seed AS INT)"


@query(f"WITH sc AS ({_SCORED}) SELECT type, node_id, CAST(r AS INT) AS rank FROM (SELECT type, node_id, row_number() OVER (PARTITION BY type ORDER BY round({_PRE}, 6) DESC, node_id) AS r FROM sc) WHERE r <= 100")
def preselection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 best of each group by similarity, centrality and seed bonus."""
    df = sql(spark, sf_dir, _SCORED).select(F.col("type").alias("query_id"), "node_id", F.expr(_PRE).alias("score"))
    return R.top_k(df, 100, "node_id").select(F.col("query_id").alias("type"), "node_id", "rank")


_ASKERS = "SELECT c_custkey AS query_id, lower(c_mktsegment) || ' getBy' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' size_' || (c_custkey % 50) AS text FROM customer WHERE c_custkey % 100 = 0"
_ASKERS_SPARK = "SELECT c_custkey AS query_id, lower(c_mktsegment) || ' getBy' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' size_' || (c_custkey % 50) AS text FROM customer WHERE c_custkey % 100 = 0"
_TAGS = "SELECT DISTINCT lower(p_type) || '-size_' || p_size || ' ' || CASE WHEN p_partkey % 5 = 0 THEN 'building' WHEN p_partkey % 5 = 1 THEN 'machinery' WHEN p_partkey % 5 = 2 THEN 'getByHousehold' ELSE p_brand END AS tag FROM part"
_DROPPED = quoted(sorted(set(words.STOP_WORDS) - set(words.CODE_KEYWORDS)))
_code_words = lambda src, key, text: f"""(WITH tk AS (SELECT {key} AS k, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM {src}),
ok AS (SELECT k, t, lower(t) AS l, regexp_extract_all(t, '[a-z]+|[A-Z][a-z]*') AS cp FROM tk WHERE lower(t) NOT IN ({_DROPPED}))
SELECT k, l AS w FROM ok UNION SELECT k, lower(unnest(cp)) FROM ok WHERE len(cp) > 1 AND NOT (upper(t) = t AND lower(t) <> t) UNION SELECT k, w FROM (SELECT k, unnest(string_split(l, '_')) AS w FROM ok WHERE contains(l, '_')) WHERE w <> '' AND w NOT IN ({quoted(words.STOP_WORDS)}))"""  # noqa: E731


@query(
    f"""WITH aq AS ({_ASKERS}), tg AS ({_TAGS}), qw AS (SELECT * FROM {_code_words("aq", "query_id", "text")}), tw AS (SELECT * FROM {_code_words("tg", "tag", "tag")}), qn AS (SELECT k, count(*) AS n FROM qw GROUP BY k),
sc AS (SELECT qw.k AS query_id, tw.k AS tag, count(*) * 1.0 / any_value(n) AS score FROM qw JOIN tw USING (w) JOIN qn ON qn.k = qw.k GROUP BY qw.k, tw.k) {_TOP("sc", 5, "tag")}"""
)
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tags of all parts by the share of a query's code tokens."""
    return R.token_overlap(sql(spark, sf_dir, _ASKERS_SPARK), sql(spark, sf_dir, _TAGS), 5)


def _grounded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    live = E.without_superseded(model(spark, sf_dir, "edges"))
    return model(spark, sf_dir, "nodes"), E.active(live, model(spark, sf_dir, "nodes"))


@query(
    """WITH old AS (SELECT DISTINCT target FROM edges WHERE type = 'supersedes'),
live AS (SELECT * FROM edges WHERE source NOT IN (SELECT target FROM old) AND source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes))
SELECT node_id, node_id IN (SELECT source FROM live) OR node_id IN (SELECT target FROM live) AS grounded FROM nodes"""
)
def grounding_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a node touches an active edge that nothing supersedes."""
    nodes, live = _grounded(spark, sf_dir)
    ends = live.select(F.col("source").alias("node_id")).union(live.select("target")).distinct().withColumn("g", F.lit(True))
    return nodes.join(ends, "node_id", "left").select("node_id", F.coalesce("g", F.lit(False)).alias("grounded"))


def _name(prefix: str) -> Column:
    return F.coalesce(F.nullif(f"{prefix}.title", F.lit("")), f"{prefix}.path")


@query(
    """SELECT DISTINCT coalesce(nullif(a.title, ''), a.path) AS s, e.type AS p, coalesce(nullif(b.title, ''), b.path) AS o
FROM edges e JOIN nodes a ON a.node_id = e.source JOIN nodes b ON b.node_id = e.target WHERE e.type IN ('hierarchy', 'call')"""
)
def grounding_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as triples of titles."""
    e, n = model(spark, sf_dir, "edges").filter("type IN ('hierarchy', 'call')"), model(spark, sf_dir, "nodes")
    return e.join(n.alias("a"), F.col("a.node_id") == e.source).join(n.alias("b"), F.col("b.node_id") == e.target).select(_name("a").alias("s"), e.type.alias("p"), _name("b").alias("o")).distinct()


_BATCH = "SELECT item_id AS query_id, CASE WHEN item_id % 10 = 3 THEN '  ' ELSE text END AS text FROM benchmark"


@query(
    f"""WITH {_BM25.replace("item_id AS query_id", "query_id").replace("FROM benchmark", f"FROM ({_BATCH})")}, be AS ({_TOP("sp", 5)}), l AS (SELECT query_id, string_agg(doc_id, ' ' ORDER BY rank) AS found FROM be GROUP BY query_id)
SELECT q.query_id, CASE WHEN trim(text) = '' THEN 'error: empty query' ELSE 'ok' END AS status, coalesce(found, '') AS found FROM ({_BATCH}) q LEFT JOIN l USING (query_id)"""
)
def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: a batch of queries searched in one plan; those that fail say so in a row of their own and stop no other."""
    docs = table(spark, sf_dir, "documents")
    return R.batch(sql(spark, sf_dir, _BATCH), R.postings(docs, "doc_id", "text"), R.doc_stats(docs, "doc_id", "text"), 5)


@query(f"SELECT node_id, {literal('')} || title || chr(10) || path || chr(10) || content AS text FROM nodes")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, path and content joined for embedding."""
    return model(spark, sf_dir, "nodes").select("node_id", F.concat_ws("\n", "title", "path", "content").alias("text"))
