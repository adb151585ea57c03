"""Text queries: tokens, entities, topics, references, classification, sanitising."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..operators import edges as E
from ..plans.materialise import spread
from .registry import literal, query, quoted, sql, table, values

_RUNS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+')"
#: Entities of (k, text) rows: classes in order, then position; the first of each lower-cased form.
_ENT = f"""ru AS (SELECT k, text, unnest({_RUNS}) AS w, generate_subscripts({_RUNS}, 1) AS i FROM src),
cl AS (SELECT k, w, 1 AS c, i FROM ru WHERE regexp_full_match(w, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') UNION ALL SELECT k, w, 2, i FROM ru WHERE regexp_full_match(w, '[a-z_][a-z0-9_]{{2,}}') AND contains(w, '_')
UNION ALL SELECT k, w, 3, i FROM ru WHERE regexp_full_match(w, '[A-Z][A-Za-z0-9]{{2,}}') UNION ALL SELECT k, unnest(regexp_extract_all(text, '`([^`]+)`', 1)), 4, generate_subscripts(regexp_extract_all(text, '`([^`]+)`', 1), 1) FROM src),
fi AS (SELECT k, w, c, i, row_number() OVER (PARTITION BY k, lower(w) ORDER BY c, i) AS r FROM cl WHERE length(w) >= 3),
en AS (SELECT src.k, src.text, coalesce(list(w ORDER BY c, i) FILTER (r = 1), []) AS names FROM src LEFT JOIN fi ON fi.k = src.k GROUP BY src.k, src.text)"""
_TURNS = "src AS (SELECT conv_id * 1000 + turn AS k, text FROM conversations)"


def _topic(text: str, names: str) -> str:
    both = f"(lower({text}) || ' ' || lower(array_to_string({names}, ' ')))"
    score = [f"{{'s': {' + '.join(f'CAST(contains({both}, {literal(w)}) AS INT)' for w in keys)}, 'o': {-i}, 't': {literal(t)}}}" for i, (t, keys) in enumerate(words.TOPICS.items())]
    best = f"list_aggregate([{', '.join(score)}], 'max')"
    return f"CASE WHEN ({best}).s > 0 THEN ({best}).t ELSE 'general' END"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), "text")


@query(f"WITH {_TURNS}, {_ENT} SELECT k, array_to_string(names, '|') AS entities FROM en")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of every conversation turn."""
    return _turns(spark, sf_dir).select("k", F.array_join(T.entities(F.col("text")), "|").alias("entities"))


@query(f"WITH {_TURNS}, {_ENT} SELECT k, {_topic('text', 'names')} AS topic FROM en")
def topic_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of every conversation turn."""
    return _turns(spark, sf_dir).select("k", T.topic(F.col("text"), T.entities(F.col("text"))).alias("topic"))


@query(f"WITH {_TURNS}, {_ENT} SELECT k, CAST(least(1.0, len(names) / 5.0) AS DOUBLE) AS confidence FROM en WHERE least(1.0, len(names) / 5.0) >= 0.3")
def auto_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag confidence of turns, from 0.3 on."""
    return _turns(spark, sf_dir).select("k", T.tag_confidence(T.entities(F.col("text"))).alias("confidence")).filter("confidence >= 0.3")


_CODE = """SELECT CAST(p_partkey AS BIGINT) AS k, 'The `get' || p_type || 'By' || p_size || '` function in src/' || lower(p_type) || '.py:' || p_size || ' calls parse_' || lower(p_type) || '_file and ' || p_name || ' Method, see (./docs/' || p_size || '.md) HTTP ' || CASE p_partkey % 4 WHEN 0 THEN 'login token' WHEN 1 THEN 'database schema migration' WHEN 2 THEN 'pytest mock coverage' ELSE 'plain' END AS text FROM part"""


@query(f"WITH src AS ({_CODE}), {_ENT} SELECT k, array_to_string(names, '|') AS entities, {_topic('text', 'names')} AS topic, array_to_string(list_concat(names[1:3], ['topic:' || {_topic('text', 'names')}]), '|') AS tags FROM en")
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, topic and tags of code-like text."""
    none = T.strings([])
    rows = sql(spark, sf_dir, _CODE).withColumn("names", T.entities(F.col("text")))
    rows = rows.withColumn("topic", T.topic(F.col("text"), F.col("names")))
    return rows.select("k", F.array_join("names", "|").alias("entities"), "topic", F.array_join(T.suggested_tags(F.col("names"), F.col("topic"), none), "|").alias("tags"))


_DROP = quoted(sorted(set(words.STOP_WORDS) - set(words.CODE_KEYWORDS)))


@query(
    f"""WITH src AS ({_CODE}), tk AS (SELECT k, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS t FROM src),
ok AS (SELECT k, t, lower(t) AS l, regexp_extract_all(t, '[a-z]+|[A-Z][a-z]*') AS cp FROM tk WHERE lower(t) NOT IN ({_DROP})),
al AS (SELECT k, l AS w FROM ok UNION SELECT k, lower(unnest(cp)) FROM ok WHERE len(cp) > 1 AND NOT (upper(t) = t AND lower(t) <> t) UNION SELECT k, w FROM (SELECT k, unnest(string_split(l, '_')) AS w FROM ok WHERE contains(l, '_')) WHERE w <> '' AND w NOT IN ({quoted(words.STOP_WORDS)}))
SELECT k, array_to_string(list_sort(list(w)), ' ') AS tokens FROM al GROUP BY k"""
)
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code tokens, each once."""
    return sql(spark, sf_dir, _CODE).select("k", F.array_join(F.array_sort(T.code_tokens(F.col("text"))), " ").alias("tokens"))


_REFS = """WITH src AS ({0}), rf AS (SELECT k, list_concat(list_concat(regexp_extract_all(text, '`([a-zA-Z_][a-zA-Z0-9_./]*)`', 1), regexp_extract_all(text, '(?:^|[\\s(])((?:\\.?\\.?/)?[a-zA-Z0-9_\\-/]+\\.[a-zA-Z]{{1,4}})(?::\\d+)?(?:[\\s),]|$)', 1)),
regexp_extract_all(text, '(?i)\\b([a-z][a-z0-9_]{{2,}})\\s+(?:function|method|class|implementation)\\b', 1)) AS l FROM src),
un AS (SELECT k, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM rf), mi AS (SELECT k, r, min(i) AS i FROM un WHERE r <> '' GROUP BY k, r)""".format(_CODE)


@query(f"{_REFS} SELECT k, string_agg(r, '|' ORDER BY i) AS refs FROM mi GROUP BY k")
def code_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code references in order."""
    return sql(spark, sf_dir, _CODE).select("k", F.array_join(T.code_references(F.col("text")), "|").alias("refs"))


_FILES = "SELECT 'f' || p_partkey AS node_id, 'src/' || lower(p_type) || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '/main.c' END AS path, 'def get' || p_type || 'By' || p_partkey || '(x): pass' AS content FROM part"
_CONVS = _CODE.replace("'By' || p_size ||", "'By' || p_partkey ||").replace("lower(p_type) || '.py:'", "lower(p_type) || p_partkey || '.py:'")


@query(
    f"""{_REFS.replace(_CODE, _CONVS)}, fl AS ({_FILES}),
ht AS (SELECT mi.k AS source, r AS ref, node_id AS target, CASE WHEN contains(lower(path), lower(r)) THEN 'path' WHEN contains(content, r) AND regexp_matches(content, '(^|[^A-Za-z0-9_])' || regexp_escape(r) || '($|[^A-Za-z0-9_])') THEN 'content' END AS rule FROM mi, fl)
SELECT source, ref, target, rule FROM ht WHERE rule IS NOT NULL"""
)
def conversation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations linked to the nodes they name."""
    refs = spread(sql(spark, sf_dir, _CONVS)).select(F.col("k").alias("conv_id"), F.explode(T.code_references(F.col("text"))).alias("ref"))
    return E.conversation_links(refs, sql(spark, sf_dir, _FILES))


@query(
    """WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM documents), e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM benchmark)
SELECT doc_id, w AS name, count(*) AS n FROM d JOIN e USING (w) WHERE length(w) > 6 GROUP BY doc_id, w"""
)
def doc_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of entity names in documents, by a join on words."""
    names = table(spark, sf_dir, "benchmark").select(F.explode(T.runs(F.col("text"))).alias("name")).filter("length(name) > 6")
    return E.doc_mentions(names, table(spark, sf_dir, "documents"))


_ENDS = "SELECT DISTINCT p_name AS name FROM part UNION ALL SELECT 'NATION_3' UNION ALL SELECT 'nowhere at all'"
_ENT_NAMES = "SELECT upper(p_name) AS entity, 'p:' || p_partkey AS node_id FROM part WHERE p_partkey % 5 = 2"


@query(
    f"""WITH en AS ({_ENDS}), ex AS ({_ENT_NAMES}), al AS (SELECT name, node_id, 4 AS w FROM en JOIN ex ON lower(entity) = lower(name)
UNION ALL SELECT name, node_id, CASE WHEN contains(lower(path), lower(name)) THEN 3 WHEN contains(lower(title), lower(name)) THEN 2 WHEN contains(lower(content), lower(name)) THEN 1 END FROM en JOIN nodes ON true),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY w DESC, node_id) AS r FROM al WHERE w IS NOT NULL) SELECT name, node_id, ['content', 'title', 'path', 'entity'][w] AS how FROM r WHERE r = 1"""
)
def endpoint_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of relation ends."""
    return E.endpoint_match(sql(spark, sf_dir, _ENDS), sql(spark, sf_dir, "SELECT * FROM nodes"), sql(spark, sf_dir, _ENT_NAMES))


_ASKED = [
    "how does user input flow to the database", "find data flow from request to response", "trace from ~ to logout?", "source leads to sink",
    "who calls ~", "usage of ~ here", "find function ~", "show me class ~", "is login secure", "is the function safe", "why is it slow",
    "explain the method", "how to stay safe", "dead code in module", "call graph of ~", "list all recursion", "path between ~ and 'Beta'.", "what is this",
    "which class has bug", "analyze security of code", "does main contain bug", "list files", "complexity of parse", "comments in main", "parameters of \"~\"", "subclasses of Base",
    "kod güvenli mi", "execute query now", "locals of main", "where is the readme",
]
# A question for each customer, with the customer's name for ~.
_ASK = f"SELECT id, q, lower(q) AS t FROM (SELECT c_custkey AS id, replace(tq, '~', c_name) AS q FROM customer JOIN (VALUES {values(list(enumerate(_ASKED)))}) AS v(tn, tq) ON c_custkey % {len(_ASKED)} = tn) asked_questions"
_ANY = lambda parts: "(" + " OR ".join(f"contains(t, {literal(p)})" for p in parts) + ")"
_SUM = lambda parts: "(" + " + ".join(f"CAST(contains(t, {literal(p)}) AS INT)" for p in parts) + ")"
_RX = lambda p: f"regexp_matches(t, {literal(p)})"


@query(
    f"""WITH a AS ({_ASK}) SELECT id, CASE WHEN {" OR ".join(_RX(p) for p, _, _ in words.DATAFLOW_PATTERNS)} THEN 'dataflow' WHEN {_ANY(words.STRONG_CODE)} THEN 'code' WHEN {_ANY(words.ACTIONS)} AND {_ANY(words.CODE_TERMS)} THEN 'code'
WHEN {_ANY(words.SECURITY_TERMS)} AND {_ANY(words.CODE_INDICATORS)} THEN 'hybrid' WHEN {_ANY(words.EXPLAINING)} AND {_ANY(words.CODE_TERMS)} THEN 'hybrid' WHEN {_ANY(words.SECURITY_TERMS)} AND {_ANY(words.EXPLAINING)} THEN 'hybrid' ELSE 'text' END AS class FROM a"""
)
def query_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of a question."""
    return sql(spark, sf_dir, _ASK).select("id", T.query_class(F.col("q")).alias("class"))


@query(
    f"""WITH a AS ({_ASK}) SELECT id, CAST(least((least({_SUM(words.CODE_WORDS)}, 5) + least(1.5 * ({" + ".join(f"CAST({_RX(p)} AS INT)" for p in words.CODE_PATTERNS)}), 3) + least({" + ".join(f"CAST({_RX(p)} AS INT)" for p in words.CODE_QUESTIONS)}, 2)) / 10.0, 1.0) AS DOUBLE) AS confidence FROM a"""
)
def code_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a question is about code."""
    return sql(spark, sf_dir, _ASK).select("id", T.code_confidence(F.col("q")).alias("confidence"))


@query(f"WITH a AS ({_ASK}) SELECT id, CASE {' '.join(f'WHEN {_RX(p)} THEN {literal(n)}' for p, n in words.TOOLS)} WHEN {_ANY(words.TOOL_TERMS)} THEN {literal(words.FALLBACK_TOOL)} END AS tool FROM a")
def tool_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool that answers a question."""
    return sql(spark, sf_dir, _ASK).select("id", T.tool(F.col("q")).alias("tool"))


_CHAIN = r"(?i)(from|between)\s+(.+?)\s+(to|and)\s+(.+)"


@query(
    f"""WITH a AS ({_ASK}), p AS (SELECT *, CASE WHEN contains(t, 'who calls ') THEN trim(substr(q, instr(t, 'who calls ') + 10), ' ?.') WHEN contains(t, 'usage of ') THEN trim(substr(q, instr(t, 'usage of ') + 9), ' ?.') WHEN contains(t, 'parameters of ') THEN trim(substr(q, instr(t, 'parameters of ') + 14), ' ?.') END AS c FROM a)
SELECT id, nullif(regexp_replace(string_split(c, ' ')[1], '["'']', '', 'g'), '') AS method, CASE {" ".join(f"WHEN {_RX(x)} THEN regexp_extract(t, {literal(x)}, {s})" for x, s, _ in words.DATAFLOW_PATTERNS)} END AS source, CASE {" ".join(f"WHEN {_RX(x)} THEN regexp_extract(t, {literal(x)}, {k})" for x, _, k in words.DATAFLOW_PATTERNS)} END AS sink,
CASE WHEN regexp_matches(q, {literal(_CHAIN)}) THEN trim(regexp_extract(q, {literal(_CHAIN)}, 2)) END AS chain_from, CASE WHEN regexp_matches(q, {literal(_CHAIN)}) THEN trim(regexp_extract(q, {literal(_CHAIN)}, 4), ' ?.') END AS chain_to FROM p"""
)
def tool_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method names, flow ends and chain ends in questions."""
    q = F.col("q")
    (source, sink), (a, b) = T.dataflow_ends(q), T.chain_ends(q)
    return sql(spark, sf_dir, _ASK).select("id", T.word_after(q, ["who calls ", "usage of ", "parameters of "]).alias("method"), source.alias("source"), sink.alias("sink"), a.alias("chain_from"), b.alias("chain_to"))


_TERMS = """SELECT p_partkey AS id, n, CASE n WHEN 0 THEN p_name WHEN 1 THEN ' ' || lower(p_type) || ' ' WHEN 2 THEN 'get' || p_brand WHEN 3 THEN 'user_' || p_partkey WHEN 4 THEN 'a.' || p_partkey WHEN 5 THEN 'is_' || p_size WHEN 6 THEN 'Find_me'
WHEN 7 THEN 'hesaplama' || p_size WHEN 8 THEN 'bulut' WHEN 9 THEN '' WHEN 10 THEN 'session ' || p_size WHEN 11 THEN 'call()' WHEN 12 THEN p_type ELSE 'x' || p_brand END AS term FROM part JOIN (VALUES {}) AS v(n) ON (p_partkey + n) % 3 > 0""".format(", ".join(f"({i})" for i in range(14)))


@query(
    f"""WITH t AS (SELECT id, n, trim(term) AS term FROM ({_TERMS})), k AS (SELECT id, n, term FROM t WHERE term <> '' AND NOT regexp_matches(term, '[a-z0-9][A-Z]') AND NOT contains(term, '_') AND NOT regexp_matches(term, '[./()@]')
AND NOT regexp_matches(lower(term), '^({"|".join(words.IDENTIFIER_STARTS)})')) SELECT p_partkey AS id, coalesce(string_agg(term, '|' ORDER BY n), '') AS safe FROM part LEFT JOIN k ON id = p_partkey GROUP BY p_partkey"""
)
def safe_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion terms that are no identifiers."""
    terms = sql(spark, sf_dir, _TERMS).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("terms"))
    return terms.select("id", F.array_join(T.safe_expansions(F.col("terms")), "|").alias("safe"))


@query("SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 10000) AS query FROM documents")
def safe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised query texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_query(F.col("text")).alias("query"))


_NAMES = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN p_name || '<b>:' || p_partkey || '.txt' WHEN 1 THEN '..' || p_name || '. ' WHEN 2 THEN 'con' WHEN 3 THEN 'lpt' || (p_size % 10) WHEN 4 THEN 'path/to' || chr(92) || p_partkey || '?' WHEN 5 THEN ' . '
WHEN 6 THEN repeat('x', 240 + p_size) || '.md' ELSE p_brand || '|' || p_type || '.' END AS name FROM part"""


@query(
    f"""WITH a AS (SELECT id, name, regexp_replace(regexp_replace(name, '[<>:"/\\\\|?*]', '_', 'g'), '^[. \\t\\n\\r]+|[. \\t\\n\\r]+$', '', 'g') AS s FROM ({_NAMES})), b AS (SELECT id, name, s, regexp_extract(s, '[^.](\\.[^.]*)$', 1) AS e FROM a),
c AS (SELECT id, name, CASE WHEN length(s) > 255 THEN s[:255 - length(e) - 1] || e ELSE s END AS s FROM b) SELECT id, name, CASE WHEN regexp_matches(upper(s), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || s ELSE nullif(s, '') END AS safe FROM c"""
)
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitised file names; an empty one is null."""
    return sql(spark, sf_dir, _NAMES).select("id", "name", T.safe_filename(F.col("name")).alias("safe"))


@query("SELECT event_id, strlen(props) <= 9 AS small FROM events")
def json_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size limit of JSON values in bytes."""
    return table(spark, sf_dir, "events").select("event_id", (F.octet_length("props") <= 9).alias("small"))


_VERS = "SELECT p_partkey AS id, 'v' || (p_partkey % 4) || '.' || (p_partkey % 12) || '.' || p_size AS a, CASE WHEN p_partkey % 9 = 0 THEN 'latest' ELSE (p_size % 4) || '.' || (p_partkey % 11) || '.3' END AS b FROM part"
_V = lambda c, i: f"CAST(regexp_extract({c}, '^v?(\\d+)\\.(\\d+)\\.(\\d+)$', {i}) AS INT)"


@query(
    f"""WITH v AS ({_VERS}), p AS (SELECT id, regexp_matches(b, '^v?\\d+\\.\\d+\\.\\d+$') AS ok, {', '.join(f"CASE WHEN regexp_matches({c}, '^v?\\d+\\.\\d+\\.\\d+$') THEN {_V(c, i)} END AS {c}{i}" for c in 'ab' for i in (1, 2, 3))} FROM v)
SELECT id, CASE WHEN ok THEN (a1, a2, a3) < (b1, b2, b3) END AS older, CASE WHEN ok THEN a1 = b1 END AS compatible FROM p"""
)
def version_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions compared, and compatible if of one major."""
    a, b = T.version_parts(F.col("a")), T.version_parts(F.col("b"))
    return sql(spark, sf_dir, _VERS).select("id", F.when(b.isNotNull(), a < b).alias("older"), F.when(b.isNotNull(), a["major"] == b["major"]).alias("compatible"))


_SYM = f"SELECT DISTINCT name FROM symbols UNION SELECT gname || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_' || p_size END FROM part JOIN (VALUES {values([(i, n) for i, n in enumerate([*words.GENERIC_SYMBOLS, 'TestCase', 'x_test', 'q', 'loader'])])}) AS v(gi, gname) ON p_partkey % 90 = gi"


@query(f"SELECT name, name IN ({quoted(words.GENERIC_SYMBOLS)}) OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR ends_with(name, '_test') OR length(name) <= 1 AS noisy FROM ({_SYM})")
def noisy_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbols too common to link."""
    return sql(spark, sf_dir, _SYM).select("name", T.noisy_symbol(F.col("name")).alias("noisy"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s]+')) AS INT) AS n_tokens, sha1(text) AS hash FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space token count and content hash."""
    return table(spark, sf_dir, "documents").select("doc_id", T.whitespace_tokens(F.col("text")).alias("n_tokens"), F.sha1("text").alias("hash"))


_CTX = "SELECT doc_id AS k, '## part one' || chr(10) || text || chr(10) || '## part two' || chr(10) || repeat('`', 3) || chr(10) || text || chr(10) || repeat('`', 3) || chr(10) || '## tail' || chr(10) || repeat('`', 3) || ' x' AS c FROM documents"


@query(
    f"""WITH s AS ({_CTX}), b AS (SELECT k, unnest(string_split_regex(c, '\\n## ')) AS b, generate_subscripts(string_split_regex(c, '\\n## '), 1) AS i FROM s),
t AS (SELECT k, i, trim(CASE WHEN i > 1 THEN '## ' || b ELSE b END, ' ' || chr(10)) AS b FROM b), f AS (SELECT k, i, CAST(contains(lower(b), 'part') AS INT) * 3 + CAST(contains(b, repeat('`', 3)) AS INT) AS score, length(b) AS n, contains(b, repeat('`', 3)) AS code FROM t WHERE b <> '')
SELECT k, CAST(i - 1 AS INT) AS block, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, n DESC, i) AS rank FROM f WHERE code"""
)
def code_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a context with code, best first by query match."""
    from pyspark.sql import Window as W

    parts = sql(spark, sf_dir, _CTX).select("k", F.posexplode(F.split("c", "\n(?=## )")).alias("block", "b")).withColumn("b", F.btrim("b", F.lit(" \n"))).filter("b <> ''")
    fence, q = F.lit("```"), F.lit("part")
    score = F.contains(F.lower("b"), q).cast("int") * 3 + F.contains("b", fence).cast("int")
    rank = F.row_number().over(W.partitionBy("k").orderBy(F.desc("score"), F.desc(F.length("b")), "block"))
    return parts.filter(F.contains("b", fence)).withColumn("score", score).select("k", "block", "score", rank.cast("long").alias("rank"))
