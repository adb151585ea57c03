"""Queries over code-property graphs: call graphs, policies, taint, slices, dominance.

The driver's tables hold no programs: call graphs come from keys of customers, code-property graphs, control flow and definitions
from a program for each part, whose statements depend on the part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words
from ..operators import edges as E
from ..operators import graph as G
from ..operators import programs as P
from .registry import literal, model, query, quoted, sql, values


@query("SELECT DISTINCT name FROM methods WHERE name NOT IN (SELECT callee FROM calls)")
def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that nothing calls."""
    return P.dead_code(model(spark, sf_dir, "methods").select("name").distinct(), model(spark, sf_dir, "calls"))


@query("WITH m AS (SELECT DISTINCT name FROM methods) SELECT count(*) AS methods, (SELECT count(*) FROM calls) AS calls, count(*) FILTER (name NOT IN (SELECT callee FROM calls)) AS entry_points, count(*) FILTER (name NOT IN (SELECT caller FROM calls)) AS leaves, count(*) > 0 AS valid FROM m")
def call_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and ends of the call graph."""
    return P.call_graph_stats(model(spark, sf_dir, "methods"), model(spark, sf_dir, "calls"))


@query("WITH p AS (SELECT DISTINCT caller, callee FROM calls) SELECT caller AS a, callee AS b, 'direct' AS kind FROM p WHERE caller = callee UNION ALL SELECT x.caller, x.callee, 'mutual' FROM p x JOIN p y ON x.caller = y.callee AND x.callee = y.caller WHERE x.caller < x.callee")
def recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and mutual recursion."""
    return P.recursion(model(spark, sf_dir, "calls"))


@query("SELECT callee, array_to_string(list_sort(list(DISTINCT caller)), ',') AS callers FROM calls WHERE callee = 'method_3' GROUP BY callee")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of a method."""
    return P.callers(model(spark, sf_dir, "calls"), "method_3").withColumn("callers", F.array_join("callers", ","))


@query(
    f"""WITH m AS (SELECT DISTINCT name FROM methods) SELECT DISTINCT caller, callee FROM calls WHERE caller <> callee AND NOT starts_with(callee, '<') AND NOT starts_with(callee, '__') AND callee NOT IN ({quoted(words.SKIPPED_CALLS)}) AND caller IN (SELECT name FROM m) AND callee IN (SELECT name FROM m)"""
)
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call edges between known methods."""
    return E.call_edges(model(spark, sf_dir, "calls"), model(spark, sf_dir, "methods"))


@query("WITH f AS (SELECT name, min(filename || ':' || lpad(CAST(line AS VARCHAR), 4, '0')) AS id FROM methods GROUP BY name) SELECT DISTINCT a.id AS source, b.id AS target FROM calls JOIN f a ON a.name = caller JOIN f b ON b.name = callee")
def name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names joined to the first definition."""
    at = F.concat_ws(":", "filename", F.lpad(F.col("line").cast("string"), 4, "0"))
    return P.name_edges(model(spark, sf_dir, "calls"), model(spark, sf_dir, "methods").select("name", at.alias("id"), at.alias("ord")))


@query("SELECT name, line_end - line + 1 AS lines FROM methods WHERE line_end - line + 1 > 50")
def large_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of over 50 lines."""
    return model(spark, sf_dir, "methods").select("name", (F.col("line_end") - F.col("line") + 1).alias("lines")).filter("lines > 50")


_CPG = "WITH n AS (SELECT * FROM cpg_nodes), e AS (SELECT * FROM cpg_edges)"


def _cpg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return model(spark, sf_dir, "cpg_nodes"), model(spark, sf_dir, "cpg_edges")


_IN = lambda label: f"SELECT m.name AS method, n.name, n.line, n.idx FROM n JOIN e ON e.dst = n.id AND e.label = 'AST' JOIN n m ON m.id = e.src AND m.label = 'METHOD' WHERE n.label = '{label}'"


@query(
    f"""{_CPG}, k AS ({_IN('CONTROL_STRUCTURE')}), c AS (SELECT m.name AS method, count(k.name) FILTER (k.name IN ('FOR', 'WHILE', 'DO')) AS loops, count(k.name) FILTER (k.name = 'IF') AS ifs, count(k.name) + 1 AS complexity FROM n m LEFT JOIN k ON k.method = m.name WHERE m.label = 'METHOD' GROUP BY m.name)
SELECT *, CASE WHEN complexity < 5 THEN 'low' WHEN complexity < 10 THEN 'medium' ELSE 'high' END AS rating FROM c"""
)
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control structures by method."""
    return P.complexity(*_cpg(spark, sf_dir))


_HITS = f"""{_CPG.replace("WITH", "WITH RECURSIVE", 1)}, r(id, depth) AS (SELECT id, 0 FROM n WHERE label = 'METHOD_PARAMETER_IN' UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.id AND e.label = 'REACHING_DEF' WHERE depth < 10),
arg AS (SELECT e.src AS call, n.id, n.code FROM e JOIN n ON n.id = e.dst WHERE e.label = 'AST'), tainted AS (SELECT DISTINCT call FROM arg WHERE id IN (SELECT id FROM r)),
k AS (SELECT CASE WHEN label = 'CALL' AND name IN ('strcpy', 'sprintf', 'gets', 'strcat') THEN 'NoBufferOverflow' WHEN label = 'CALL' AND name IN ('system', 'exec', 'popen') AND id IN (SELECT call FROM tainted) THEN 'NoCommandInjection'
WHEN label = 'CALL' AND name IN ('execute', 'executemany', 'query', 'raw') AND id IN (SELECT call FROM arg WHERE regexp_matches(code, '\\{{.*\\}}')) THEN 'NoSQLInjection' WHEN label = 'LITERAL' AND regexp_matches(code, '(?i)(password|secret|api[_-]?key|token).*=') THEN 'NoHardcodedSecrets'
WHEN label = 'CALL' AND name IN ('MD5', 'SHA1', 'DES', 'RC4') THEN 'NoWeakCrypto' WHEN label = 'CALL' AND name IN ('open', 'fopen', 'readFile') AND id IN (SELECT call FROM tainted) THEN 'NoPathTraversal' END AS policy, id, filename || ':' || line AS location FROM n),
hit AS (SELECT policy, CASE WHEN policy IN ('NoBufferOverflow', 'NoCommandInjection', 'NoSQLInjection') THEN 'critical' ELSE 'high' END AS severity,
CASE policy WHEN 'NoBufferOverflow' THEN 'CWE-120' WHEN 'NoCommandInjection' THEN 'CWE-78' WHEN 'NoSQLInjection' THEN 'CWE-89' WHEN 'NoHardcodedSecrets' THEN 'CWE-798' WHEN 'NoWeakCrypto' THEN 'CWE-327' ELSE 'CWE-22' END AS cwe, id, location FROM k WHERE policy IS NOT NULL)"""


@query(f"{_HITS} SELECT * FROM hit")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of all policies."""
    return P.policy_violations(*_cpg(spark, sf_dir))


@query(f"{_HITS} SELECT policy, severity, count(*) AS n FROM hit WHERE severity = 'critical' GROUP BY policy, severity")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by policy and severity, critical ones only."""
    return P.policy_violations(*_cpg(spark, sf_dir), least="critical").groupBy("policy", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CPG} SELECT x.name AS type, 'base' AS relation FROM e JOIN n x ON x.id = e.dst JOIN n y ON y.id = e.src WHERE e.label = 'INHERITS_FROM' AND y.name = 'Child_7' UNION SELECT y.name, 'derived' FROM e JOIN n x ON x.id = e.dst JOIN n y ON y.id = e.src WHERE e.label = 'INHERITS_FROM' AND x.name = 'Child_7'")
def type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases and derivations of a type."""
    nodes, edges = _cpg(spark, sf_dir)
    return P.hierarchy(edges, nodes, "Child_7")


@query(f"{_CPG.replace('WITH', 'WITH RECURSIVE', 1)}, s(id, depth) AS (SELECT id, 0 FROM n WHERE label = 'IDENTIFIER' AND name = 'cmd' UNION SELECT e.src, depth + 1 FROM s JOIN e ON e.dst = s.id AND e.label IN ('REACHING_DEF', 'CDG') WHERE depth < 10) SELECT id, CAST(min(depth) AS INT) AS depth FROM s GROUP BY id")
def backward_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a variable's uses depend on."""
    return P.backward_slice(*_cpg(spark, sf_dir), "cmd")


@query(f"{_CPG}, x AS (SELECT m.name AS method, '  \"' || c.src || '\" -> \"' || c.dst || '\"' AS l FROM e c JOIN e a ON a.dst = c.src AND a.label = 'AST' JOIN e b ON b.dst = c.dst AND b.src = a.src AND b.label = 'AST' JOIN n m ON m.id = a.src AND m.label = 'METHOD' WHERE c.label = 'CFG') SELECT method, 'digraph CFG {{' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}}' AS dot FROM (SELECT DISTINCT * FROM x) GROUP BY method".replace("{{", "{").replace("}}", "}"))
def cfg_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control flow of each method as DOT."""
    nodes, edges = _cpg(spark, sf_dir)
    return P.dot(nodes, edges, "CFG")


@query(f"{_CPG}, u AS ({_IN('IDENTIFIER')}) SELECT DISTINCT method, line FROM u WHERE name = 'cmd'")
def variable_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: uses of a variable by method and line."""
    return P.contained(*_cpg(spark, sf_dir), "IDENTIFIER").filter("name = 'cmd'").select("method", "line").distinct()


@query(f"{_CPG}, p AS ({_IN('METHOD_PARAMETER_IN')}), l AS ({_IN('LOCAL')}) SELECT method, name, 'parameter' AS kind, idx FROM p UNION ALL SELECT method, name, 'local', idx FROM l")
def parameters_and_locals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters in order and locals of methods."""
    nodes, edges = _cpg(spark, sf_dir)
    part = lambda label, kind: P.contained(nodes, edges, label).select("method", "name", F.lit(kind).alias("kind"), "idx")
    return part("METHOD_PARAMETER_IN", "parameter").union(part("LOCAL", "local"))


@query(f"{_CPG}, p AS ({_IN('METHOD_PARAMETER_IN')}), u AS ({_IN('IDENTIFIER')}) SELECT method, name FROM p WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.method = p.method AND u.name = p.name)")
def unused_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters without a use."""
    return P.unused_parameters(*_cpg(spark, sf_dir))


@query(f"{_CPG} SELECT id, label FROM n WHERE (label = 'COMMENT' AND contains(code, 'TODO')) OR label IN ('TAG', 'ANNOTATION', 'IMPORT') OR (label = 'LITERAL' AND contains(lower(code), 'pass')) OR (label = 'METHOD' AND starts_with(name, 'handle_1')) OR (label = 'CALL' AND name IN ('strcpy', 'popen'))")
def labelled_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label and pattern."""
    nodes, _ = _cpg(spark, sf_dir)
    wanted = (("COMMENT", "TODO", "code"), ("TAG", None, "name"), ("ANNOTATION", None, "name"), ("IMPORT", None, "name"), ("LITERAL", "(?i).*pass.*", "code"), ("METHOD", "^handle_1", "name"), ("CALL", "^(strcpy|popen)$", "name"))
    found = [P.labelled(nodes, *w).select("id", "label") for w in wanted]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query(f"{_CPG} SELECT DISTINCT label, name FROM n WHERE label IN ('FILE', 'NAMESPACE', 'TYPE_DECL') AND NOT starts_with(name, '<')")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: files, namespaces and types."""
    nodes, _ = _cpg(spark, sf_dir)
    lists = [P.names_of(nodes, label).select(F.lit(label).alias("label"), "name") for label in ("FILE", "NAMESPACE", "TYPE_DECL")]
    return lists[0].union(lists[1]).union(lists[2])


@query(f"{_CPG} SELECT DISTINCT name, CASE label WHEN 'METHOD' THEN 'definition' WHEN 'CALL' THEN 'call' WHEN 'IMPORT' THEN 'import' ELSE 'reference' END AS type FROM n WHERE label IN ('METHOD', 'CALL', 'IDENTIFIER', 'LOCAL', 'IMPORT')")
def cpg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a program."""
    return P.cpg_entities(_cpg(spark, sf_dir)[0])


_WEB_SQL = "WITH RECURSIVE n AS (SELECT * FROM web_nodes), e AS (SELECT * FROM web_flows)"
_HAS = lambda side: "(" + " OR ".join(f"contains(lower(content), {literal(p)})" for p in sorted({p.lower() for *_, s, p in P.catalogue() if s == side})) + ")"
_CASE = lambda at: "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(n.content), {literal(s.lower())})" for s in v[4]) + f" THEN {literal(v[at])}" for v in words.VULNERABILITIES) + f" ELSE '{'Unknown' if at == 0 else 'Medium'}' END"


@query(
    f"""{_WEB_SQL}, p(path, node) AS (SELECT [node_id], node_id FROM n WHERE {_HAS("source")} UNION SELECT list_append(path, target), target FROM p JOIN e ON source = node WHERE len(path) <= 10 AND NOT list_contains(path, target)),
b AS (SELECT path[1] AS source, node AS sink, path, row_number() OVER (PARTITION BY path[1], node ORDER BY len(path), path) AS r FROM p WHERE len(path) > 1 AND node IN (SELECT node_id FROM n WHERE {_HAS("sink")}))
SELECT source, sink, array_to_string(path, ' > ') AS path, {_CASE(0)} AS kind, {_CASE(2)} AS severity, CAST(round(greatest(0, 1 - 0.1 * (len(path) - 2)), 2) AS DOUBLE) AS confidence FROM b JOIN n ON node_id = sink WHERE r = 1"""
)
def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow paths from sources to sinks with kind and confidence."""
    return P.taint_paths(model(spark, sf_dir, "web_nodes"), model(spark, sf_dir, "web_flows")).withColumn("path", F.array_join("path", " > "))


@query(f"SELECT t.cwe, t.kind, t.severity, t.side, t.pattern, count(*) AS n FROM web_nodes JOIN (VALUES {values(P.catalogue())}) AS t(ord, kind, cwe, severity, side, pattern) ON contains(lower(content), lower(t.pattern)) GROUP BY ALL")
def vulnerability_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many statements match each vulnerability pattern."""
    return P.pattern_matches(model(spark, sf_dir, "web_nodes")).groupBy("cwe", "kind", "severity", "side", "pattern").agg(F.count(F.lit(1)).alias("n"))


_RANKED = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'critical' WHEN 2 THEN 'LOW' WHEN 3 THEN 'medium' ELSE 'info' END AS severity, CAST(c_custkey % 11 AS DOUBLE) / 10 AS confidence FROM customer"


@query(f"SELECT id, severity, confidence FROM ({_RANKED}) ORDER BY CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, confidence DESC, id LIMIT 10")
def gravest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the ten gravest findings."""
    return P.severity_order(sql(spark, sf_dir, _RANKED), 10)


_PLACES = "SELECT c_custkey AS place_id, CASE c_custkey % 3 WHEN 0 THEN 'src/' || lower(c_mktsegment) || '.c' WHEN 1 THEN lower(c_mktsegment) || '.c' ELSE 'gone.c' END AS file, CAST(c_custkey % 300 AS INT) AS line FROM customer"
_SPANS = "SELECT 'f' || c_custkey AS node_id, CASE WHEN c_custkey % 2 = 0 THEN 'src/' ELSE 'lib/src/' END || lower(c_mktsegment) || '.c' AS path, CAST(c_custkey % 290 AS INT) AS line_start, CAST(c_custkey % 290 + 9 AS INT) AS line_end FROM customer WHERE c_custkey < 400"


@query(
    f"""WITH p AS ({_PLACES}), s AS ({_SPANS}), x AS (SELECT place_id, node_id FROM p JOIN s ON path = file AND line BETWEEN line_start AND line_end),
y AS (SELECT place_id, node_id FROM p JOIN s ON ends_with(path, file) AND list_extract(string_split(path, '/'), -1) = list_extract(string_split(file, '/'), -1) AND line BETWEEN line_start AND line_end WHERE place_id NOT IN (SELECT place_id FROM x))
SELECT place_id, min(node_id) AS node_id FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY place_id"""
)
def located_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at a file and line, with the suffix fallback."""
    return P.located(sql(spark, sf_dir, _PLACES), sql(spark, sf_dir, _SPANS))


@query("WITH m AS (SELECT DISTINCT name FROM methods), a AS (SELECT name AS source FROM m WHERE regexp_matches(name, '^method_1') ORDER BY name LIMIT 10), b AS (SELECT name AS sink FROM m WHERE regexp_matches(name, '7$') ORDER BY name LIMIT 10) SELECT source, sink FROM a, b WHERE source <> sink")
def tainted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: unverified pairs of ten sources and ten sinks by name."""
    return P.tainted_candidates(model(spark, sf_dir, "methods"), "^method_1", "7$")


_dom = lambda start, src, dst: f"""WITH RECURSIVE f AS (SELECT method, {src} AS src, {dst} AS dst FROM control), v AS (SELECT DISTINCT method, src AS node FROM f UNION SELECT DISTINCT method, dst FROM f),
r(method, cutoff, node) AS (SELECT v.method, v.node, '{start}' FROM v WHERE v.node <> '{start}' UNION SELECT r.method, r.cutoff, f.dst FROM r JOIN f ON f.method = r.method AND f.src = r.node WHERE f.dst <> r.cutoff),
a(method, node) AS (SELECT DISTINCT method, '{start}' FROM f UNION SELECT f.method, f.dst FROM a JOIN f ON f.method = a.method AND f.src = a.node),
dm AS (SELECT a.method, a.node, b.node AS dominator FROM a JOIN a b ON b.method = a.method LEFT JOIN r ON r.method = a.method AND r.cutoff = b.node AND r.node = a.node WHERE r.node IS NULL OR a.node = b.node)"""  # noqa: E731


@query(f"{_dom('in', 'src', 'dst')} SELECT DISTINCT method, node, dominator FROM dm")
def dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominators of each node, against removal of the dominator."""
    return P.dominators(model(spark, sf_dir, "control"), "in").select("method", "node", "dominator")


_CDG = """SELECT DISTINCT c.method, p.dominator AS node, c.src AS "on" FROM control c JOIN dm p ON p.method = c.method AND p.node = c.dst JOIN a ON a.method = c.method AND a.node = c.dst
WHERE NOT EXISTS (SELECT 1 FROM dm q WHERE q.method = c.method AND q.node = c.src AND q.dominator = p.dominator AND q.node <> q.dominator)"""


@query(f"{_dom('out', 'dst', 'src')} {_CDG}")
def control_dependences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that depend on a branch, against removal of the post-dominator."""
    return P.control_dependences(model(spark, sf_dir, "control"), "out").select("method", "node", "on")


_DDG = """p AS (SELECT c.method, t.var, c.src, c.dst FROM control c JOIN (SELECT DISTINCT method, var FROM facts) t ON t.method = c.method LEFT JOIN facts k ON k.method = c.method AND k.node = c.src AND k.var = t.var AND k.kind = 'def' WHERE k.node IS NULL),
z(method, var, def, node) AS (SELECT d.method, d.var, d.node, c.dst FROM facts d JOIN control c ON c.method = d.method AND c.src = d.node WHERE d.kind = 'def' UNION SELECT z.method, z.var, z.def, p.dst FROM z JOIN p ON p.method = z.method AND p.var = z.var AND p.src = z.node),
ddg AS (SELECT DISTINCT z.method, z.def AS src, z.node AS dst, z.var FROM z JOIN facts u ON u.method = z.method AND u.node = z.node AND u.var = z.var AND u.kind = 'use')"""


@query(f"WITH RECURSIVE {_DDG} SELECT * FROM ddg")
def reaching_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data dependences made from control flow, definitions and uses."""
    return P.reaching_definitions(model(spark, sf_dir, "control"), model(spark, sf_dir, "facts"))


_PDG = f"{_dom('out', 'dst', 'src')}, cdg AS ({_CDG}), {_DDG}, pdg AS (SELECT method, src, dst, 'DDG' AS label FROM ddg UNION SELECT method, \"on\", node, 'CDG' FROM cdg)"


@query(f"{_PDG} SELECT method, src, dst, label FROM pdg")
def program_dependences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The program dependence graph, data and control dependences in one."""
    return P.program_dependences(model(spark, sf_dir, "control"), model(spark, sf_dir, "facts"), "out")


@query(f"{_PDG}, l AS (SELECT method, label, '  \"' || src || '\" -> \"' || dst || '\"' AS l FROM pdg) SELECT method, label, 'digraph ' || label || ' {{' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}}' AS dot FROM l GROUP BY method, label".replace("{{", "{").replace("}}", "}"))
def dependence_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and control dependences of each method as DOT."""
    return P.once_each([model(spark, sf_dir, "control"), model(spark, sf_dir, "facts")], lambda c, f: P.dot_of(P.program_dependences(c, f, "out")))


@query(f"{_PDG}, s(method, node, depth) AS (SELECT DISTINCT method, node, 0 FROM facts WHERE var = 'cmd' AND kind = 'use' UNION SELECT s.method, pdg.src, depth + 1 FROM s JOIN pdg ON pdg.method = s.method AND pdg.dst = s.node WHERE depth < 10) SELECT method, node, CAST(min(depth) AS INT) AS depth FROM s GROUP BY method, node")
def dependence_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward slices of the uses of a variable over dependences that are made, not given."""
    tables = [model(spark, sf_dir, "control"), model(spark, sf_dir, "facts")]
    return P.once_each(tables, lambda c, f: P.dependence_slice(P.program_dependences(c, f, "out"), f, "cmd", 10))


@query("WITH RECURSIVE s(node, depth) AS (SELECT 'p:1', 0 UNION SELECT e.target, depth + 1 FROM s JOIN edges e ON e.source = s.node AND e.type = 'data_flow' WHERE depth < 5) SELECT node, CAST(min(depth) AS INT) AS depth FROM s GROUP BY node")
def dataflow_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What data flows to from a node."""
    flow = model(spark, sf_dir, "edges").filter("type = 'data_flow'")
    return G.reachable(spark.sql("SELECT 'p:1' AS node"), G.adjacency(flow, "forward"), 5)


_METHOD_NAMES = "SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'test_' || p_size WHEN 1 THEN 'x' WHEN 2 THEN 'run_' || p_partkey WHEN 3 THEN '__init__' ELSE 'Test' || p_brand END AS name FROM part"


@query(f"SELECT name, starts_with(name, 'test_') OR starts_with(name, 'Test') OR length(name) <= 1 OR name = '__init__' AS noisy FROM ({_METHOD_NAMES})")
def noisy_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names aside when linking code."""
    return sql(spark, sf_dir, _METHOD_NAMES).select("name", T.noisy_symbol(F.col("name")).alias("noisy"))
