"""Queries over entities, snippets and serialised rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import entities as N
from ..sources import conversations as S
from .registry import model, query, sql, table

_SRC = """SELECT 'p:' || p_partkey AS node_id, 'import os as sys' || p_size || chr(10) || 'class ' || p_type || '_' || p_size || ':' || chr(10) || '    def run_' || p_size || '(self):' || chr(10) || '        return open_' || lower(p_type) || '(1)' || chr(10) || 'total = 5' AS content FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'p:' || p_partkey, 'public void load' || p_size || '(int x) {{ const go' || p_size || ' = (a) => 1; }}' FROM part WHERE p_partkey % 4 = 0""".replace("{{", "{").replace("}}", "}")
_WANT = """SELECT 'p:' || p_partkey AS node_id, u.pos, u.name, u.type FROM part, (VALUES (0), (1), (2), (3), (4)) k(pos),
LATERAL (SELECT CAST(k.pos AS INT) AS pos, CASE k.pos WHEN 0 THEN 'sys' || p_size WHEN 1 THEN p_type || '_' || p_size WHEN 2 THEN 'total' WHEN 3 THEN 'run_' || p_size ELSE 'open_' || lower(p_type) END AS name, CASE WHEN k.pos IN (0, 4) THEN 'reference' ELSE 'definition' END AS type) u WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'p:' || p_partkey, 0, 'go' || p_size, 'definition' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'p:' || p_partkey, 1, 'load' || p_size, 'definition' FROM part WHERE p_partkey % 4 = 0"""


@query(_WANT)
def syntax_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of Python by its syntax tree, of other code by patterns."""
    return N.entities_of(sql(spark, sf_dir, _SRC)).select("node_id", "pos", "name", "type")


_OLD = "SELECT 'n' || (p_partkey % 50) AS node_id, CAST(p_partkey AS INT) AS pos, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'call' ELSE 'definition' END AS type, 'old ' || p_partkey AS description FROM part WHERE p_partkey % 3 = 0"
_NEW = _OLD.replace("'old '", "'new '").replace("% 3 = 0", "% 3 <> 0")


@query(f"WITH b AS (SELECT 0 AS o, * FROM ({_OLD}) UNION ALL SELECT 1, * FROM ({_NEW})) SELECT node_id, name, type, description FROM (SELECT *, row_number() OVER (PARTITION BY node_id, name, type ORDER BY o, pos) AS r FROM b) WHERE r = 1")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity lists merged, the first of each name and type."""
    return N.merged(sql(spark, sf_dir, _OLD), sql(spark, sf_dir, _NEW))


@query("SELECT sha1('tagged_snippets/' || tag || '.md|' || sha1(content)) AS node_id, sha1(content) AS hash, 'tagged_snippets/' || tag || '.md' AS path, CAST(len(regexp_extract_all(content, '[^\\s]+')) AS INT) AS token_count, CAST(ts AS BIGINT) AS created_at, tokens FROM (SELECT 'get' || upper(substr(role, 1, 1)) || substr(role, 2) || '-' || turn AS tag, text AS content, conv_id * 100 AS ts, CASE role WHEN 'user' THEN 'get getuser user' WHEN 'assistant' THEN 'assistant get getassistant' ELSE 'get getsystem system' END AS tokens FROM conversations)")
def snippet_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged snippets as nodes with code tokens of the tag."""
    c = table(spark, sf_dir, "conversations")
    tag = F.concat(F.lit("get"), F.initcap("role"), F.lit("-"), F.col("turn").cast("string"))
    rows = c.select(tag.alias("tag"), F.col("text").alias("content"), "conv_id", F.lit("why").alias("question"), (F.col("conv_id") * 100).alias("at"))
    return N.snippets(rows).select("node_id", "hash", "path", "token_count", "created_at", F.col("metadata")["tag_tokens"].alias("tokens"))


@query("SELECT source, target, type, score, ord FROM edges")
def edge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to JSON and back."""
    return N.edges_from_json(N.to_json(model(spark, sf_dir, "edges"))).select("source", "target", "type", "score", "ord")


@query("SELECT CAST(item_id AS BIGINT) AS item_id, md5('Be brief.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'some context' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' || chr(10) || chr(10) || 'KNOWN_IDENTIFIERS (you may only reference these):' || chr(10) || 'a, b' || chr(10) || chr(10) || 'Explanation Data:' || chr(10) || substr(repeat(text, 100), 1, 10000) || CASE WHEN length(text) * 100 > 10000 THEN chr(10) || '[truncated]' ELSE '' END) AS hash FROM benchmark")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with identifiers and a cut explanation."""
    b = table(spark, sf_dir, "benchmark")
    text = N.prompt("Be brief.", F.col("text"), F.lit("some context"), F.array(F.lit("b"), F.lit("a"), F.lit(""), F.lit("b")), F.repeat(F.col("text"), 100))
    return b.select("item_id", F.md5(text).alias("hash"))


_LOGS = "SELECT CASE p_partkey % 5 WHEN 0 THEN 'x/antigravity/brain/' || p_partkey || '/log.txt' WHEN 1 THEN 'x/' || p_partkey || '.aichat' WHEN 2 THEN 'x/' || p_partkey || '.json' WHEN 3 THEN 'x/' || p_partkey || '/entries.json' ELSE 'x/' || p_partkey || '.md' END AS path, CASE p_partkey % 5 WHEN 2 THEN '{\"uuid\": 1}' WHEN 3 THEN '{}' ELSE 'text' END AS content FROM part"


@query(f"WITH l AS ({_LOGS}) SELECT editor, count(*) AS n FROM (SELECT CASE WHEN contains(path, 'antigravity') THEN 'antigravity' WHEN ends_with(path, '.aichat') THEN 'cursor' WHEN ends_with(path, 'entries.json') THEN 'github_copilot' WHEN contains(content, 'uuid') THEN 'claude' END AS editor FROM l) WHERE editor IS NOT NULL GROUP BY editor")
def conversations_by_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation files counted by editor."""
    rows = sql(spark, sf_dir, _LOGS).select(S.log_format(F.col("path"), F.col("content")).alias("editor"))
    return rows.filter("editor IS NOT NULL").groupBy("editor").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, count(*) AS n FROM (SELECT 'METHOD' AS name FROM methods) GROUP BY name")
def cpg_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw query over code-property graph views, as SQL."""
    model(spark, sf_dir, "methods").createOrReplaceTempView("cpg_methods")
    return spark.sql("SELECT 'METHOD' AS name, count(*) AS n FROM cpg_methods")


_WEIGHTS = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.ROLE_WEIGHTS.items()) + f" ELSE {schema.DEFAULT_ROLE_WEIGHT} END"


@query(f"SELECT type, CAST({_WEIGHTS} AS DOUBLE) AS weight, count(*) AS n FROM nodes GROUP BY type")
def role_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, H1: how many nodes have each type's weight."""
    weights = schema.dimension(spark, schema.ROLE_WEIGHTS, "type", "weight")
    rows = model(spark, sf_dir, "nodes").join(F.broadcast(weights), "type", "left")
    return rows.groupBy("type", F.coalesce("weight", F.lit(schema.DEFAULT_ROLE_WEIGHT)).alias("weight")).agg(F.count(F.lit(1)).alias("n"))
