"""Registration, and the model tables derived from the driver's tables in SQL that both engines run."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from ..plans.materialise import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def literal(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_d = lambda x: f"CAST({x} AS DOUBLE)"
_b = lambda x: f"CAST({x} AS BIGINT)"



def values(rows) -> str:
    """Rows of strings and numbers as SQL values."""
    return ", ".join("(" + ", ".join(literal(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


# One program for each part, by these rows: a row is there if the part's key modulo `every` is `rest` and its size at least `least`.  ~ stands for the
# key, @ for the brand, $ for the size.
_PROGRAM = [
    ("m1", "METHOD", "handle_~", "handle(req)", 1, 0, 1, 0, 0), ("m2", "METHOD", "load_~", "load(p)", 30, 0, 1, 0, 0), ("m3", "METHOD", "<init>", "", 0, 0, 1, 0, 0),
    ("p1", "METHOD_PARAMETER_IN", "req", "req", 1, 1, 1, 0, 0), ("p2", "METHOD_PARAMETER_IN", "p", "p", 30, 1, 1, 0, 0), ("p3", "METHOD_PARAMETER_IN", "mode", "mode", 30, 2, 2, 0, 0),
    ("i1", "IDENTIFIER", "req", "req", 2, 1, 3, 0, 0), ("i1", "IDENTIFIER", "req", "req", 2, 1, 3, 1, 0), ("i2", "IDENTIFIER", "cmd", "cmd", 3, 1, 1, 0, 0), ("i3", "IDENTIFIER", "p", "p", 31, 1, 1, 0, 0), ("i4", "IDENTIFIER", "sql", "{sql}", 9, 1, 2, 0, 0), ("i4", "IDENTIFIER", "sql", "sql", 9, 1, 2, 1, 0),
    ("l1", "LOCAL", "cmd", "cmd", 2, 0, 1, 0, 0), ("l2", "LOCAL", "sql_$", "sql", 8, 0, 1, 0, 0),
    ("c1", "CALL", "system", "system(cmd)", 3, 0, 4, 0, 0), ("c1", "CALL", "run", "run(cmd)", 3, 0, 4, 1, 0), ("c2", "CALL", "open", "open(p)", 31, 0, 1, 0, 20), ("c3", "CALL", "execute", "execute(sql)", 9, 0, 1, 0, 0), ("c4", "CALL", "strcpy", "strcpy(a, b)", 7, 0, 3, 0, 0), ("c5", "CALL", "MD5", "MD5(x)", 8, 0, 4, 1, 0), ("c6", "CALL", "popen", "popen(ls)", 10, 0, 5, 2, 0),
    ("t1", "LITERAL", "", "password = x~", 4, 0, 7, 3, 0), ("t2", "LITERAL", "", "hello @", 5, 0, 1, 0, 0), ("t3", "LITERAL", "", "API_KEY=$", 5, 0, 6, 0, 0),
    ("k0", "CONTROL_STRUCTURE", "IF", "if", 5, 0, 1, 0, 0), ("k1", "CONTROL_STRUCTURE", "FOR", "for", 6, 0, 2, 1, 0), ("k2", "CONTROL_STRUCTURE", "WHILE", "while", 7, 0, 3, 1, 0), ("k3", "CONTROL_STRUCTURE", "DO", "do", 8, 0, 5, 0, 0),
    *[(f"k{i}", "CONTROL_STRUCTURE", "IF", "if", 10 + i, 0, 1, 0, 5 * (i - 3)) for i in range(4, 13)],
    ("y1", "TYPE_DECL", "Base_@", "", 50, 0, 1, 0, 0), ("y2", "TYPE_DECL", "Child_$", "", 60, 0, 1, 0, 0), ("y3", "TYPE_DECL", "Grand_~", "", 70, 0, 2, 0, 0), ("y4", "TYPE_DECL", "<none>", "", 0, 0, 1, 0, 0),
    ("o1", "COMMENT", "", "# TODO: fix ~", 11, 0, 3, 0, 0), ("o2", "COMMENT", "", "# plain", 12, 0, 1, 0, 0), ("g1", "TAG", "http_@", "", 0, 0, 9, 0, 0), ("n1", "ANNOTATION", "route", "@", 1, 0, 8, 1, 0),
    ("z1", "IMPORT", "os", "import os", 1, 0, 1, 0, 0), ("z2", "IMPORT", "json", "import json", 1, 0, 2, 0, 0), ("f1", "FILE", "a~.py", "", 0, 0, 1, 0, 0), ("f3", "FILE", "<unknown>", "", 0, 0, 1, 0, 0), ("s1", "NAMESPACE", "app_$", "", 0, 0, 1, 0, 0),
]
# Its edges, by the same rule.
_PROGRAM_EDGES = (
    [("m1", x, "AST", 1, 0) for x in ("p1", "i1", "i2", "i4", "l1", "l2", "c1", "c3", "t1", "t2", *[f"k{i}" for i in range(13)])]
    + [("m2", x, "AST", 1, 0) for x in ("p2", "p3", "i3", "c2")]
    + [("c1", "i2", "AST", 1, 0), ("c2", "i3", "AST", 1, 0), ("c3", "i4", "AST", 1, 0)]
    + [("p1", "i1", "REACHING_DEF", 1, 0), ("i1", "i2", "REACHING_DEF", 2, 0), ("p2", "i3", "REACHING_DEF", 3, 0), ("p2", "i3", "REACHING_DEF", 3, 1), ("t2", "i4", "REACHING_DEF", 1, 0)]
    + [("k0", "c1", "CDG", 1, 0), ("k0", "i2", "CDG", 3, 2), ("i1", "c1", "CFG", 1, 0), ("c1", "c3", "CFG", 2, 1), ("i3", "c2", "CFG", 1, 0)]
    + [("y2", "y1", "INHERITS_FROM", 1, 0), ("y3", "y2", "INHERITS_FROM", 2, 0)]
)
# A web program for each part, and what flows where.
_WEB_PROGRAM = [("w1", "x = request.args.get('q')", 1, 0), ("w2", "y = x.strip()", 1, 0), ("w3", "cursor.execute(y)", 2, 0), ("w3", "log(y)", 2, 1), ("w4", "os.system(x)", 3, 0), ("w5", "name = input('?')", 1, 0), ("w6", "open(name).read()", 1, 0), ("w7", "requests.get(url)", 1, 0), ("w8", "print(1)", 1, 0), ("w9", "eval(y)", 5, 1)]
_WEB_FLOWS = [("w1", "w2", 1, 0), ("w2", "w3", 1, 0), ("w1", "w4", 2, 1), ("w5", "w6", 3, 1), ("w5", "w8", 1, 0), ("w8", "w6", 1, 0), ("w2", "w9", 1, 0), ("w8", "w2", 4, 1), ("w2", "w8", 5, 1)]
# Control flow of two methods for each part, and what their nodes define and use.
_CONTROL = [("f", "in", "a", 1, 0), ("f", "a", "b", 1, 0), ("f", "a", "c", 1, 0), ("f", "b", "d", 1, 0), ("f", "c", "d", 1, 0), ("f", "d", "a", 2, 0), ("f", "d", "out", 1, 0), ("f", "b", "out", 3, 1), ("g", "in", "x", 1, 0), ("g", "x", "out", 1, 0), ("g", "in", "out", 4, 0), ("g", "lost", "out", 1, 0), ("g", "x", "y", 5, 2), ("g", "y", "x", 5, 2)]
_FACTS = [
    ("f", "in", "req", "def", 1, 0), ("f", "a", "req", "use", 1, 0), ("f", "a", "n", "def", 1, 0), ("f", "b", "n", "use", 1, 0), ("f", "b", "cmd", "def", 1, 0), ("f", "c", "cmd", "def", 3, 0), ("f", "c", "req", "def", 5, 1), ("f", "d", "cmd", "use", 1, 0), ("f", "d", "req", "use", 1, 0), ("f", "out", "n", "use", 2, 1),
    ("g", "in", "p", "def", 1, 0), ("g", "x", "p", "use", 1, 0), ("g", "x", "p", "def", 4, 2), ("g", "y", "p", "use", 1, 0), ("g", "out", "p", "use", 1, 0), ("g", "lost", "p", "def", 1, 0),
]
_filled = lambda c: f"replace(replace(replace({c}, '~', '' || p_partkey), '@', p_brand), '$', '' || p_size)"

#: Model tables as common table expressions, in order: later ones may use earlier ones.
MODEL = {
    "edges": f"""SELECT 'o:' || l_orderkey AS source, 'p:' || l_partkey AS target, 'reference' AS type, {_d("round(0.5 + l_discount * 3, 2)")} AS score, {_b("l_orderkey * 10 + l_linenumber")} AS ord FROM lineitem
UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'call', {_d(0.8)}, {_b("1000000000 + o_orderkey")} FROM orders
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'hierarchy', {_d(1)}, {_b("2000000000 + c_custkey")} FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'hierarchy', {_d(1)}, {_b("3000000000 + s_suppkey")} FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'hierarchy', {_d(1)}, {_b("4000000000 + n_nationkey")} FROM nation
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'data_flow', {_d(0.7)}, {_b("5000000000 + l_orderkey * 10 + l_linenumber")} FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'p:' || p_partkey, 'p:' || (p_partkey + 1), 'semantic', {_d(0.4)}, {_b("6000000000 + p_partkey")} FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT 'o:' || (o_orderkey + 1), 'o:' || o_orderkey, 'supersedes', {_d(1)}, {_b("7000000000 + o_orderkey")} FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'o:' || (o_orderkey + 2), 'o:' || o_orderkey, 'contradicts', {_d(1)}, {_b("8000000000 + o_orderkey")} FROM orders WHERE o_orderkey % 75 = 0
UNION ALL SELECT 'v:' || o_custkey, 'o:' || o_orderkey, 'conversation_references_code', {_d(0.9)}, {_b("9000000000 + o_orderkey")} FROM orders WHERE o_orderkey % 9 = 0""",
    "nodes": """SELECT 'p:' || p_partkey AS node_id, 'src/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '/' || p_partkey || '.py' AS path, p_name AS title, p_name || ' ' || p_type || ' ' || p_brand AS content, 'code' AS type, CAST(p_size * 40 AS INT) AS token_count FROM part
UNION ALL SELECT 'o:' || o_orderkey, 'orders/' || o_orderstatus || '/' || o_orderkey || '.md', 'order ' || o_orderkey, 'order of ' || o_custkey || ' at ' || o_orderpriority, 'text', CAST(o_orderkey % 1500 AS INT) FROM orders
UNION ALL SELECT 'c:' || c_custkey, 'customers/' || lower(c_mktsegment) || '/' || c_custkey || '/readme.md', c_name, c_name || ' in ' || c_mktsegment, 'readme', CAST(c_custkey % 90 AS INT) FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'suppliers/' || s_suppkey || '/tsconfig.json', s_name, s_name, 'config', CAST(30 AS INT) FROM supplier
UNION ALL SELECT 'n:' || n_nationkey, 'nations/' || lower(n_name) || '.txt', n_name, n_name, 'documentation', CAST(12 AS INT) FROM nation
UNION ALL SELECT 'r:' || r_regionkey, 'nations/readme.md', r_name, r_name, 'readme', CAST(9 AS INT) FROM region""",
    "claims": """SELECT event_id AS claim_id, 'User ' || user_id AS entity, event_type AS attribute, CAST(value AS DOUBLE) AS value, CASE WHEN event_id % 17 = 0 THEN '' ELSE substr(CAST(CAST(ts AS DATE) AS VARCHAR(10)), 1, 10) END AS valid_at FROM events""",
    "triples": """SELECT n_name AS s, 'in_region' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, 'in_nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT c_name, 'in_nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_name, 'segment', c_mktsegment FROM customer""",
    "asked": """SELECT CAST(c_custkey * 4 AS BIGINT) AS id, '  ' || upper(c_name) || ' ' AS s, 'in_nation' AS p, 'NATION_' || (c_custkey % 25) AS o FROM customer
UNION ALL SELECT c_custkey * 4 + 1, c_name, 'segment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey * 4 + 2, c_name, 'belongs_to', c_mktsegment FROM customer
UNION ALL SELECT c_custkey * 4 + 3, c_name, 'in_nation', 'AFRICA' FROM customer""",
    "aliases": """SELECT substr(c_name, 1, 16) AS alias, 'c:' || c_custkey AS entity_id FROM customer
UNION ALL SELECT c_name, 'c:' || c_custkey FROM customer
UNION ALL SELECT s_name, 's:' || s_suppkey FROM supplier""",
    "contexts": """SELECT 'c:' || c_custkey AS entity_id, c_mktsegment AS token FROM customer UNION ALL SELECT 'c:' || c_custkey, 'bal' || CAST(floor(c_acctbal / 500) AS INT) FROM customer""",
    "mentions": """SELECT CAST(c_custkey AS BIGINT) AS mention_id, substr(c_name, 1, 16) AS surface, 'bal' || CAST(floor(c_acctbal / 500) AS INT) AS token FROM customer
UNION ALL SELECT 100000000 + c_custkey, c_name, 'none' FROM customer UNION ALL SELECT 200000000 + c_custkey, 'nobody ' || c_custkey, 'none' FROM customer""",
    "files_old": """SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, md5(text) AS hash FROM documents WHERE doc_id % 13 <> 0""",
    "files_new": """SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0""",
    "versions": """SELECT 'v' || d AS version_id, CAST(d * 86400 AS BIGINT) AS ts, CAST(sum(n) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS node_count, CAST(sum(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS edge_count FROM
(SELECT CAST(extract(DAY FROM ts) AS INT) AS d, count(*) AS n, count(DISTINCT user_id) AS v FROM events GROUP BY CAST(extract(DAY FROM ts) AS INT)) x""",
    "symbols": """SELECT 'p:' || p_partkey AS node_id, replace(p_name, ' ', '_') || '_' || (p_partkey % 50) AS name, CASE WHEN p_partkey % 50 = p_size THEN 'definition' WHEN p_partkey % 3 = 0 THEN 'call' ELSE 'reference' END AS kind FROM part
UNION ALL SELECT 'p:' || p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'test_' || p_type ELSE 'run' END, 'definition' FROM part UNION ALL SELECT 'p:' || p_partkey, 'run', 'reference' FROM part""",
    "names": """SELECT 'o:' || l_orderkey AS node_id, 'Part ' || l_partkey AS name FROM lineitem""",
    "cpg_nodes": f"""SELECT p_partkey || ':' || tid AS id, label, {_filled("tname")} AS name, {_filled("tcode")} AS code, 'a' || p_partkey || '.py' AS filename, CAST(tline AS INT) AS line, CAST(tidx AS INT) AS idx, '' AS type_full_name
FROM part JOIN (VALUES {values(_PROGRAM)}) AS t(tid, label, tname, tcode, tline, tidx, every, rest, least) ON p_partkey % every = rest AND p_size >= least""",
    "cpg_edges": f"""SELECT p_partkey || ':' || tsrc AS src, p_partkey || ':' || tdst AS dst, label FROM part JOIN (VALUES {values(_PROGRAM_EDGES)}) AS t(tsrc, tdst, label, every, rest) ON p_partkey % every = rest""",
    "web_nodes": f"""SELECT p_partkey || ':' || tid AS node_id, content FROM part JOIN (VALUES {values(_WEB_PROGRAM)}) AS t(tid, content, every, rest) ON p_partkey % every = rest""",
    "web_flows": f"""SELECT p_partkey || ':' || tsrc AS source, p_partkey || ':' || tdst AS target, 'data_flow' AS type FROM part JOIN (VALUES {values(_WEB_FLOWS)}) AS t(tsrc, tdst, every, rest) ON p_partkey % every = rest""",
    "control": f"""SELECT tmethod || p_partkey AS method, src, dst FROM part JOIN (VALUES {values(_CONTROL)}) AS t(tmethod, src, dst, every, rest) ON p_partkey % every = rest""",
    "facts": f"""SELECT tmethod || p_partkey AS method, node, var, kind FROM part JOIN (VALUES {values(_FACTS)}) AS t(tmethod, node, var, kind, every, rest) ON p_partkey % every = rest""",
    "calls": """SELECT 'method_' || c_custkey AS caller, 'method_' || ((c_custkey * 7 + 3) % 1000) AS callee FROM customer
UNION ALL SELECT 'method_' || c_custkey, 'method_' || (c_custkey % 10) FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'method_' || ((c_custkey * 7 + 3) % 1000), 'method_' || c_custkey FROM customer WHERE c_custkey % 40 = 0
UNION ALL SELECT 'method_' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'print' ELSE '<operator>.add' END FROM customer WHERE c_custkey % 20 = 1
UNION ALL SELECT 'method_' || c_custkey, 'method_' || c_custkey FROM customer WHERE c_custkey % 60 = 2""",
    "methods": """SELECT 'method_' || c_custkey AS name, 'src/' || lower(c_mktsegment) || '.c' AS filename, CAST(c_custkey % 300 AS INT) AS line, CAST(c_custkey % 300 + floor(c_acctbal / 100) AS INT) AS line_end FROM customer""",
}


def _used(sql: str) -> list[str]:
    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in MODEL:
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(MODEL[name])
    return [n for n in MODEL if n in need]


def with_model(sql: str, recursive: bool = False) -> str:
    """sql with the model tables that it reads in front; sql may begin with its own WITH list after a leading 'WITH'."""
    names = _used(sql)
    own = sql.strip()
    recursive = recursive or own.upper().startswith("WITH RECURSIVE")
    own = re.sub(r"^WITH(\s+RECURSIVE)?\s+", ", " if names else "", own, flags=re.I) if own.upper().startswith("WITH") else own
    head = ", ".join(f"{n} AS ({MODEL[n]})" for n in names)
    if not names:
        return sql
    return f"WITH{' RECURSIVE' if recursive else ''} {head} {own}"


#: Texts of a task, about.
TEXT_ROWS = 20_000
#: Where each part becomes the rows of a program; and the parts of a task there.
_MANY, PROGRAM_PARTS = "FROM part JOIN (VALUES", 20_000


def sql(spark: SparkSession, sf_dir: str, text: str, dealt: bool = False) -> DataFrame:
    """Run SQL over model and driver tables; each table is read straight from its file, but for parts that programs are made of, or with `dealt` all
    parts, which are dealt out before."""
    text = with_model(text)
    if dealt or _MANY in text:
        view = f"part_{md5(sf_dir.encode()).hexdigest()}"
        spread(spark.read.parquet(f"{sf_dir}/part.parquet"), PROGRAM_PARTS).createOrReplaceTempView(view)
        text = re.sub(r"\bFROM part\b" if dealt else re.escape("FROM part") + r"(?= JOIN \(VALUES)", f"FROM {view}", text)
    for t in TABLES:
        text = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sql(spark, sf_dir, f"SELECT * FROM {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; texts are spread over all cores before any work on them, and over tasks of TEXT_ROWS if these are more."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_ROWS) if name in ("documents", "conversations") else df


def query(oracle: str | None = None, name: str | None = None):
    """Register a query, with the DuckDB SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are called {key}")
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = with_model(oracle)
        return f

    return add


def quoted(values) -> str:
    """A list of SQL string literals."""
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
