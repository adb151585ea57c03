"""Ingest queries: sources, markdown, chunks, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..operators import analytics as A
from ..operators import chunking as K
from ..operators import unitizer as U
from ..plans import index as I
from ..sources import conversations as S
from ..sources import exports
from ..sources import files
from ..sources import store
from .registry import literal, model, query, quoted, sql, table

_PATHS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'app/environment/' WHEN 3 THEN 'target/' WHEN 4 THEN 'https://github.com/x/' ELSE 'docs/' END || lower(p_type) || CASE p_partkey % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.tsx' WHEN 2 THEN '.md' WHEN 3 THEN '.aichat' WHEN 4 THEN '.log' WHEN 5 THEN '.json' WHEN 6 THEN '.rs' WHEN 7 THEN '/README' ELSE '.c' END AS path,
CAST(p_partkey * 791 AS BIGINT) AS bytes, CAST(p_size AS INT) AS lines FROM part"""
_LANG = "CASE WHEN list_has_any(string_split(path, '/'), [{}]) THEN NULL ELSE map_extract_value(MAP {{{}}}, lower(regexp_extract(path, '(\\.[^./]+)$', 1))) END".format(quoted(words.EXCLUDED_FOLDERS), ", ".join(f"'{k}': '{v}'" for k, v in words.LANGUAGES.items()))


@query(f"WITH p AS ({_PATHS}) SELECT id, CASE WHEN contains(path, 'github.com') THEN 'repository' WHEN ends_with(path, '.aichat') OR (ends_with(path, '.json') AND id % 2 = 0) THEN 'conversation' WHEN ends_with(path, '.md') THEN 'markdown' ELSE 'directory' END AS type FROM p")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source types of paths, JSON files with chat keys among them."""
    keys = F.when(F.col("id") % 2 == 0, T.strings(["messages"])).otherwise(T.strings(["x"]))
    return sql(spark, sf_dir, _PATHS).select("id", files.source_type(F.col("path"), keys).alias("type"))


@query(f"WITH p AS ({_PATHS}) SELECT id, NOT ({' OR '.join(f'contains(path, {quoted([s])})' for s in words.SKIP_PATTERNS)}) AND regexp_extract(path, '[^/.][^/]*(\\.[^./]*)$', 1) NOT IN ({quoted(words.SKIP_EXTENSIONS)}) AND bytes BETWEEN 1 AND 1000000 AS kept FROM p")
def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the filter keeps."""
    return sql(spark, sf_dir, _PATHS).select("id", files.kept(F.col("path"), F.col("bytes")).alias("kept"))


@query(f"WITH p AS ({_PATHS}) SELECT id, {_LANG} AS language FROM p")
def code_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by extension outside excluded folders."""
    return sql(spark, sf_dir, _PATHS).select("id", files.language(F.col("path")).alias("language"))


@query(f"WITH p AS ({_PATHS}), c AS (SELECT {_LANG} AS language, lines, bytes FROM p) SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, round(CAST(sum(bytes) AS DOUBLE) / 1048576, 6) AS mb FROM c WHERE language IS NOT NULL GROUP BY language")
def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and size by language."""
    own = sql(spark, sf_dir, _PATHS).withColumn("language", files.language(F.col("path"))).filter("language IS NOT NULL")
    return A.language_stats(own)


@query(f"WITH p AS ({_PATHS}), c AS (SELECT {_LANG} AS language, lines FROM p) SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) >= 5 AND sum(lines) >= 100 AS worth FROM c WHERE language IS NOT NULL")
def cpg_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether code is worth a code-property graph."""
    own = sql(spark, sf_dir, _PATHS).withColumn("language", files.language(F.col("path"))).filter("language IS NOT NULL")
    return files.worth_analysing(own)


@query(f"WITH p AS ({_PATHS}), c AS (SELECT id, path, {_LANG} AS language FROM p) SELECT id, sha1('# ' || path || chr(10) || chr(10) || repeat('`', 3) || coalesce(language, '') || chr(10) || 'x = ' || id || chr(10) || repeat('`', 3) || chr(10)) AS hash FROM c")
def wrapped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files wrapped as markdown, hashed."""
    rows = sql(spark, sf_dir, _PATHS)
    text = files.wrapped(F.col("path"), files.language(F.col("path")), F.concat(F.lit("x = "), F.col("id").cast("string")))
    return rows.select("id", F.sha1(text).alias("hash"))


# Documents as markdown: a heading of level 1 to 4 before every line, the text itself as body, fences in some.
_MD = """SELECT CAST(doc_id AS VARCHAR) AS doc, 'lost line' || chr(10) || '# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '```py' || chr(10) || 'x = 1' || chr(10) || '```' ELSE 'plain' END || chr(10) || '#### deep' || chr(10) || 'body' || chr(10) || '### mid' || chr(10) || text || chr(10) || '# again ' || doc_id || chr(10) || chr(10) || 'end' AS text FROM documents"""
_MD_SPARK = _MD.replace("CAST(doc_id AS VARCHAR)", "CAST(doc_id AS STRING)")
_SECTIONS = f"""WITH src AS ({_MD}), ln AS (SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM src),
hd AS (SELECT *, CASE WHEN regexp_matches(line, '^(#{{1,4}})\\s+(\\S.*)$') THEN length(regexp_extract(line, '^(#{{1,4}})\\s+(\\S.*)$', 1)) END AS level, CASE WHEN regexp_matches(line, '^(#{{1,4}})\\s+(\\S.*)$') THEN trim(regexp_extract(line, '^(#{{1,4}})\\s+(\\S.*)$', 2)) END AS header FROM ln),
sc AS (SELECT *, count(level) OVER (PARTITION BY doc ORDER BY pos) AS section FROM hd),
st AS (SELECT h.doc, h.section, h.level, h.header, h.pos, (SELECT string_agg(a.header, ' > ' ORDER BY a.pos) FROM sc a WHERE a.doc = h.doc AND a.level IS NOT NULL AND a.pos <= h.pos AND (a.pos = h.pos OR (a.level < h.level AND NOT EXISTS (SELECT 1 FROM sc b WHERE b.doc = a.doc AND b.level <= a.level AND b.pos > a.pos AND b.pos <= h.pos)))) AS header_path FROM sc h WHERE h.level IS NOT NULL),
bd AS (SELECT doc, section, string_agg(line, chr(10) ORDER BY pos) FILTER (level IS NULL) AS body, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, coalesce(bool_or(starts_with(ltrim(line), '```')) FILTER (level IS NULL), false) AS has_code FROM sc WHERE section > 0 GROUP BY doc, section),
fin AS (SELECT doc, section, CAST(level AS INT) AS level, header, header_path, coalesce(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '') AS content, CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end, has_code FROM bd JOIN st USING (doc, section))"""


def _md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _MD_SPARK)


@query(f"{_SECTIONS} SELECT * FROM fin")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with header paths."""
    return K.sections(_md(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN contains(p, 'readme') THEN 'readme' WHEN regexp_matches(p, 'config|\\.yaml|\\.yml|\\.json|\\.toml|\\.ini') THEN 'config' WHEN c THEN 'code' ELSE 'text' END AS section_type, CASE WHEN c THEN 'code' WHEN contains(p, 'readme') THEN 'readme' WHEN regexp_matches(p, 'config|\\.yaml|\\.yml|\\.json|\\.toml|\\.ini') THEN 'config' ELSE 'text' END AS node_type FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a/readme.md' WHEN 1 THEN 'a/config/x.md' WHEN 2 THEN 'a/b.toml' ELSE 'a/c.md' END AS p, doc_id % 2 = 0 AS c FROM documents)")
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of sections and of nodes."""
    p = F.when(F.col("doc_id") % 5 == 0, "a/readme.md").when(F.col("doc_id") % 5 == 1, "a/config/x.md").when(F.col("doc_id") % 5 == 2, "a/b.toml").otherwise("a/c.md")
    c = F.col("doc_id") % 2 == 0
    return table(spark, sf_dir, "documents").select("doc_id", K.section_type(p, c).alias("section_type"), K.node_type(p, c).alias("node_type"))


@query(f"WITH src AS ({_MD}), b AS (SELECT doc, unnest(regexp_extract_all(text, '(?s)```(\\w+)?\\n(.*?)\\n```', 2)) AS code FROM src) SELECT doc, CAST(0 AS INT) AS n, 'py' AS lang, trim(code) AS code FROM b")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced code blocks."""
    return K.code_blocks(_md(spark, sf_dir))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents as markdown, small enough a limit that sections are split."""
    rows = _md(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n# whole\n"), F.repeat(F.col("text"), 3)))
    return K.chunks(rows, 1500, 20)


@query("SELECT doc_id AS doc, CAST(n AS INT) AS n, substr(text, CAST(n * 1000 + 1 AS BIGINT), 1000) AS piece FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 999) // 1000)) AS n FROM documents)")
def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width slices of all documents."""
    return K.slices(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), 1000)


@query("SELECT sha1(ltrim('/' || path, '/') || '|' || sha1(text) || '|0') AS node_id, sha1(text) AS hash, lang AS title, ltrim('/' || path, '/') AS path, 'text' AS type FROM (SELECT *, source || '/' || doc_id || '.md' AS path FROM documents)")
def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as nodes with deterministic ids."""
    d = table(spark, sf_dir, "documents").select(F.lit(0).alias("n"), F.col("text").alias("content"), F.col("lang").alias("header"), F.lit(False).alias("has_code"), F.lit(1).alias("token_count"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("at"))
    return K.nodes_from_chunks(d, F.col("at")).select("node_id", "hash", "title", "path", "type")


_MESSY = "SELECT doc_id AS id, chr(10) || '# ' || lang || chr(13) || chr(10) || '#  next' || chr(10) || replace(replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || '## more' || chr(13)), ', ', ', ' || chr(10) || chr(10)) || chr(10) || chr(10) || chr(10) AS text FROM documents"
_STEPS = ((r"\r\n?", "\n"), (r"(?m)[ \t\f\v]+$", ""), (r"^\n+\z", "\n"), (r"^\n{3,}", "\n\n"), (r"\n{3,}\z", "\n\n"), (r"\n{4,}", "\n\n\n"), (r"(?m)^(#[^\n]*)\n([^\n])", r"\1" + "\n\n" + r"\2"), (r"(?m)^(#[^\n]*)\n([^\n])", r"\1" + "\n\n" + r"\2"))


def _normal(text: str) -> str:
    for pattern, to in _STEPS:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(to)}, 'g')"
    return text


@query(f"SELECT id, {_normal('text')} AS text FROM ({_MESSY})")
def normal_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised markdown of all documents with line ends, blanks and headings put in."""
    return sql(spark, sf_dir, _MESSY).select("id", T.markdown(F.col("text")).alias("text"))


def _logs(turns: DataFrame) -> DataFrame:
    """(path, content): a log of each conversation, of one editor's format by its id."""
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = lambda f: F.transform("m", f)
    key = F.col("conv_id").cast("string")
    cursor = F.to_json(F.struct(key.alias("id"), F.lit("t").alias("title"), said(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    claude = F.to_json(F.struct(key.alias("uuid"), F.lit("t").alias("name"), said(lambda x: F.struct(x["role"].alias("sender"), x["text"].alias("text"))).alias("chat_messages")))
    copilot = F.to_json(F.struct(key.alias("sessionId"), said(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("value"))).alias("messages")))
    entries = F.to_json(F.struct(said(lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("entries")))
    tagged = F.array_join(said(lambda x: F.when(x["role"] == "user", F.concat(F.lit("<USER_REQUEST>"), x["text"], F.lit("</USER_REQUEST>"))).otherwise(F.lit("..."))), "\n")
    kind = F.col("conv_id") % 5
    path = F.when(kind == 0, F.concat(F.lit("logs/"), key, F.lit(".aichat"))).when(kind == 1, F.concat(F.lit("logs/claude"), key, F.lit(".json"))).when(kind == 2, F.concat(F.lit("logs/copilot"), key, F.lit(".json")))
    path = path.when(kind == 3, F.concat(F.lit("logs/"), key, F.lit(".json"))).otherwise(F.concat(F.lit("logs/antigravity/brain/"), key, F.lit("/task.txt")))
    return by.select(path.alias("path"), F.when(kind == 0, cursor).when(kind == 1, claude).when(kind == 2, copilot).when(kind == 3, entries).otherwise(tagged).alias("content"))


@query(
    """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, role, text FROM conversations),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM t WHERE role = 'user' AND conv_id % 5 = 4)
SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS INT) AS turn, CASE WHEN conv_id % 5 = 0 OR role = 'assistant' THEN role ELSE 'user' END AS role, text, CASE conv_id % 5 WHEN 0 THEN 'cursor' WHEN 1 THEN 'claude' ELSE 'github_copilot' END AS source FROM t WHERE conv_id % 5 < 4
UNION ALL SELECT CAST(conv_id AS VARCHAR), CAST(turn AS INT), 'user', text, 'antigravity' FROM u"""
)
def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as logs of four editors, told apart and parsed back into turns."""
    return S.conversations(_logs(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", "role", "text", "source")


@query(
    """WITH m AS (SELECT conv_id, turn, '## Message ' || (turn + 1) || ' - ' || CASE role WHEN 'user' THEN '👤' WHEN 'assistant' THEN '🤖' ELSE '⚙️' END || ' ' || upper(role[1]) || role[2:] || ' (--:--:--)' || chr(10) || chr(10) || text || chr(10) AS m FROM conversations)
SELECT conv_id, '# Conversation: log ' || conv_id || chr(10) || chr(10) || '**ID**: ' || conv_id || chr(10) || '**Messages**: ' || count(*) || chr(10) || '**Source**: table' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(m, chr(10) ORDER BY turn, m) AS text FROM m GROUP BY conv_id"""
)
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as markdown."""
    rows = table(spark, sf_dir, "conversations").withColumns({"title": F.concat(F.lit("log "), F.col("conv_id").cast("string")), "source": F.lit("table"), "at": F.lit(None).cast("string")})
    return S.as_markdown(rows)


def _reparsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = model(spark, sf_dir, "cpg_nodes")
    shards = exports.shard_count(nodes)
    return store.graphml(exports.graphml_documents(nodes, model(spark, sf_dir, "cpg_edges"), shards=shards), exports.task_count(spark, shards))


@query("SELECT id, label, nullif(name, '') AS name, nullif(code, '') AS code, filename, line FROM cpg_nodes")
def graphml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of GraphML documents, written from the programs of all parts and parsed back."""
    return _reparsed(spark, sf_dir)[0]


@query("SELECT DISTINCT src, dst, label FROM cpg_edges")
def graphml_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of these documents."""
    return _reparsed(spark, sf_dir)[1]


@query(
    """SELECT 's' || s_suppkey AS doc, CAST(0 AS INT) AS n, 'Company is a maker.' AS unit, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS o FROM supplier
UNION ALL SELECT 's' || s_suppkey, 1, 'Company was founded in ' || (1990 + s_suppkey % 30) || '.', NULL, NULL, NULL FROM supplier UNION ALL SELECT 's' || s_suppkey, 2, 'Company produces the Part' || s_suppkey || '..', NULL, NULL, NULL FROM supplier
UNION ALL SELECT 's' || s_suppkey, 3, NULL, 'Company', 'founded_in', '' || (1990 + s_suppkey % 30) FROM supplier UNION ALL SELECT 's' || s_suppkey, 4, NULL, 'Company', 'is_a', 'maker' FROM supplier UNION ALL SELECT 's' || s_suppkey, 5, NULL, 'Company', 'produces', 'the Part' || s_suppkey FROM supplier"""
)
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of made-up profiles as units and rule edges."""
    text = F.concat(F.lit("Company is a maker founded in "), (F.lit(1990) + F.col("s_suppkey") % 30).cast("string"), F.lit(". Its product is the Part"), F.col("s_suppkey").cast("string"), F.lit("."))
    return U.units(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("doc"), text.alias("text")))


@query()
def built_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of documents taken as files."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".py").otherwise(".md"))
    return I.build_nodes(d.select(path.alias("path"), F.col("n_chars").alias("bytes"), F.concat(F.lit("# "), "lang", F.lit("\n"), "text").alias("content"))).drop("content")


_MARKS = "SELECT 'p' || p_partkey AS node_id, lower(p_type) || '-' || p_size AS tag, lower(p_type) || ' ' || p_size AS tag_tokens, p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'economy' ELSE p_brand END || ' ' || lower(p_type) || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_name ELSE '' END AS content FROM part"
_SEARCHED = "red economy"


@query(
    f"""WITH m AS ({_MARKS}), f AS (SELECT node_id, 1 AS field, tag_tokens AS t FROM m UNION ALL SELECT node_id, 2, tag FROM m UNION ALL SELECT node_id, 3, content FROM m),
w AS (SELECT node_id, field, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM f), k AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY field),
p AS (SELECT node_id, field, len(w) AS size, q, len(list_filter(w, lambda x: x = q)) AS tf FROM w JOIN (SELECT unnest([{quoted(_SEARCHED.split())}]) AS q) ON list_contains(w, q)), d AS (SELECT field, q, count(*) AS df FROM p GROUP BY field, q),
s AS (SELECT node_id, field, count(*) AS hits, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM p JOIN d USING (field, q) JOIN k USING (field) GROUP BY node_id, field)
SELECT node_id, round(sum(score), 6) AS score FROM s WHERE hits = {len(_SEARCHED.split())} GROUP BY node_id"""
)
def bookmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of all parts with all words of a query in one field, by BM25 over the fields that match."""
    return store.bookmark_search(sql(spark, sf_dir, _MARKS), _SEARCHED, 1 << 30)
