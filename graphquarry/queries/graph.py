"""Graph queries: traversal, impact, paths, components, centrality, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import edges as E
from ..operators import betweenness as B
from ..operators import graph as G
from ..operators.components import connected_components
from ..operators.retrieval import rounded
from .registry import model, query, quoted, sql

_BFS = lambda steps, seeds, hops: f"""WITH RECURSIVE st AS ({steps}), bf(node, depth) AS (SELECT node, 0 FROM ({seeds}) UNION SELECT st.dst, bf.depth + 1 FROM bf JOIN st ON st.src = bf.node WHERE bf.depth < {hops})
SELECT node, CAST(min(depth) AS INT) AS depth FROM bf GROUP BY node"""  # noqa: E731
_F, _B = "SELECT source AS src, target AS dst FROM edges", "SELECT target AS src, source AS dst FROM edges"
_SEEDS = "SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey < 3 UNION ALL SELECT 'absent'"
_AWARE = f"SELECT source AS src, target AS dst FROM edges WHERE type NOT IN ({quoted(schema.UNTRAVERSED_TYPES)}) UNION SELECT target, source FROM edges WHERE type NOT IN ({quoted((*schema.UNTRAVERSED_TYPES, *schema.DIRECTED_TYPES))})"


@query(_BFS(f"{_F} UNION {_B}", _SEEDS, 2))
def khop_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected reachability with depth, absent seeds included."""
    return G.reachable(sql(spark, sf_dir, _SEEDS), G.adjacency(model(spark, sf_dir, "edges"), "undirected"), 2)


@query(_BFS(_AWARE, _SEEDS, 4))
def khop_reference_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability by directed and undirected edge types."""
    return G.reachable(sql(spark, sf_dir, _SEEDS), G.adjacency(model(spark, sf_dir, "edges")), schema.MAX_HOPS)


_PARTS = "SELECT 'p:' || p_partkey AS node FROM part WHERE p_partkey % 100 = 0"


@query(_BFS(f"{_B} WHERE type IN ('reference', 'call')", _PARTS, 3))
def reverse_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse reachability over chosen edge types."""
    e = model(spark, sf_dir, "edges").filter("type IN ('reference', 'call')")
    return G.reachable(sql(spark, sf_dir, _PARTS), G.adjacency(e, "reverse"), 3)


_IMPACT = f"""WITH RECURSIVE ta AS ({_PARTS}), im(target, node, depth) AS (SELECT node, node, 0 FROM ta UNION SELECT im.target, e.source, im.depth + 1 FROM im JOIN edges e ON e.target = im.node WHERE im.depth < 3),
fi AS (SELECT target, node, min(depth) AS depth FROM im GROUP BY target, node),
vi AS (SELECT f.target, f.node, CAST(f.depth AS INT) AS depth, min(e.ord) AS via FROM fi f JOIN edges e ON e.source = f.node JOIN fi g ON g.target = f.target AND g.node = e.target AND g.depth = f.depth - 1 WHERE f.depth > 0 GROUP BY f.target, f.node, f.depth)"""


def _impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.impact(sql(spark, sf_dir, _PARTS), model(spark, sf_dir, "edges"), 3)


@query(f"{_IMPACT} SELECT * FROM vi")
def reverse_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependents with depth and discovering edge."""
    return _impact(spark, sf_dir)


@query(
    f"""{_IMPACT}, al AS (SELECT target, node, depth FROM vi UNION ALL SELECT node, node, 0 FROM ta)
SELECT target, CAST(max(depth) AS INT) AS depth, count(DISTINCT path) AS breadth, count(*) - 1 AS dependents FROM al LEFT JOIN nodes ON node_id = node GROUP BY target"""
)
def impact_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and breadth of an impact, the target's file included."""
    found = _impact(spark, sf_dir).select("target", "node", "depth")
    own = sql(spark, sf_dir, _PARTS).select(F.col("node").alias("target"), "node", F.lit(0).alias("depth"))
    both = found.unionByName(own).join(model(spark, sf_dir, "nodes").select(F.col("node_id").alias("node"), "path"), "node", "left")
    return both.groupBy("target").agg(F.max("depth").alias("depth"), F.countDistinct("path").alias("breadth"), (F.count(F.lit(1)) - 1).alias("dependents"))


@query(f"{_IMPACT} SELECT path, count(*) AS n FROM vi JOIN nodes ON node_id = node GROUP BY path ORDER BY path LIMIT 20")
def impact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 files that an impact touches."""
    nodes = model(spark, sf_dir, "nodes").select(F.col("node_id").alias("node"), "path")
    return _impact(spark, sf_dir).join(nodes, "node").groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy("path").limit(20)


_PATTERN = "SELECT node_id AS node FROM nodes WHERE contains(lower(path), 'src/economy/blue') AND type = 'code'"


@query(f"WITH RECURSIVE ta AS ({_PATTERN}), im(target, node, depth) AS (SELECT node, node, 0 FROM ta UNION SELECT im.target, e.source, im.depth + 1 FROM im JOIN edges e ON e.target = im.node WHERE im.depth < 1) SELECT target, node, CAST(min(depth) AS INT) AS depth FROM im GROUP BY target, node HAVING min(depth) > 0")
def impact_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of all nodes whose path has a substring."""
    return G.impact(sql(spark, sf_dir, _PATTERN), model(spark, sf_dir, "edges"), 1).select("target", "node", "depth")


_FLOW = "SELECT source, target, type, score, ord FROM edges WHERE type IN ('call', 'reference', 'data_flow')"
_SRC, _SINK = "SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey < 5", "SELECT 's:' || s_suppkey AS node FROM supplier WHERE s_suppkey < 5"


@query(
    f"""WITH RECURSIVE fl AS ({_FLOW}), pa(path, node) AS (SELECT [node], node FROM ({_SRC}) UNION SELECT list_append(pa.path, fl.target), fl.target FROM pa JOIN fl ON fl.source = pa.node WHERE len(pa.path) <= 4 AND NOT list_contains(pa.path, fl.target))
SELECT array_to_string(path, ' > ') AS path, CAST(len(path) - 1 AS INT) AS hops FROM pa WHERE len(path) > 1 AND node IN (SELECT node FROM ({_SINK}))"""
)
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths from sources to sinks over flow edges."""
    paths = G.simple_paths(sql(spark, sf_dir, _SRC), sql(spark, sf_dir, _SINK), sql(spark, sf_dir, _FLOW), 4)
    return paths.select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("hops"))


_COMP = "SELECT source, target, type, score, ord FROM edges WHERE type IN ('semantic', 'supersedes', 'contradicts')"


@query(
    f"""WITH RECURSIVE ce AS ({_COMP}), st AS (SELECT source AS src, target AS dst FROM ce UNION SELECT target, source FROM ce),
re(node, root) AS (SELECT src, src FROM st UNION SELECT st.dst, re.root FROM re JOIN st ON st.src = re.node)
SELECT node, min(root) AS component FROM re GROUP BY node"""
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of every node with an edge."""
    return connected_components(sql(spark, sf_dir, _COMP), "source", "target")


@query(
    f"""WITH RECURSIVE ce AS ({_COMP}), st AS (SELECT source AS src, target AS dst FROM ce UNION SELECT target, source FROM ce),
re(node, root) AS (SELECT src, src FROM st UNION SELECT st.dst, re.root FROM re JOIN st ON st.src = re.node),
co AS (SELECT node, min(root) AS component FROM re GROUP BY node), sz AS (SELECT component, count(*) AS n FROM co GROUP BY component), de AS (SELECT src, count(*) AS d FROM st GROUP BY src)
SELECT node, round(d / (n - 1), 6) AS degree FROM co JOIN sz USING (component) JOIN de ON de.src = node"""
)
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree centrality within components."""
    e = sql(spark, sf_dir, _COMP)
    return G.degree_centrality(e, connected_components(e, "source", "target")).withColumn("degree", rounded(F.col("degree")))


@query(
    """SELECT least(source, target) AS a, greatest(source, target) AS b, round(arg_max(score * CASE WHEN type = 'reference' THEN 2 ELSE 1 END, lpad(CAST(ord AS VARCHAR), 12, '0') || lpad(CAST(CAST(round(score * 1000) AS INT) AS VARCHAR), 6, '0')), 6) AS weight FROM edges WHERE source <> target GROUP BY 1, 2"""
)
def weighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected weighted graph, parallel edges collapsed to the last."""
    return G.weighted_pairs(model(spark, sf_dir, "edges")).withColumn("weight", rounded(F.col("weight")))


_GO = "SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey < 10"


@query(
    f"""WITH RECURSIVE bf(node, depth) AS (SELECT node, 0 FROM ({_GO}) UNION SELECT e.target, bf.depth + 1 FROM bf JOIN edges e ON e.source = bf.node WHERE bf.depth < 1),
f AS (SELECT node, min(depth) AS depth FROM bf GROUP BY node)
SELECT DISTINCT e.source, e.type, e.target, CAST(f.depth AS INT) AS depth, substr(sha1('(''' || e.source || ''', ''' || e.type || ''', ''' || e.target || ''')'), 1, 8) AS citation FROM edges e JOIN f ON f.node = e.source"""
)
def cited_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a bounded directed traversal with citation ids."""
    found = G.traversed_edges(sql(spark, sf_dir, _GO), model(spark, sf_dir, "edges"), 2)
    return found.select("source", "type", "target", "depth", G.citation_id(F.col("source"), F.col("type"), F.col("target")).alias("citation"))


@query("SELECT source, target, type, ord FROM edges WHERE source IN (SELECT node_id FROM nodes WHERE type = 'code') AND target IN (SELECT node_id FROM nodes WHERE type = 'code')")
def active_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the active nodes."""
    return E.active(model(spark, sf_dir, "edges"), model(spark, sf_dir, "nodes").filter("type = 'code'")).select("source", "target", "type", "ord")


@query("SELECT e.source, e.target, e.type, e.ord FROM edges e LEFT JOIN (SELECT DISTINCT target FROM edges WHERE type = 'supersedes') s ON s.target = e.source WHERE s.target IS NULL")
def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges whose source nothing supersedes."""
    return E.without_superseded(model(spark, sf_dir, "edges")).select("source", "target", "type", "ord")


_BROKEN_N = "SELECT node_id, CASE WHEN node_id LIKE '%7' THEN 'XYZ' ELSE sha1(content) END AS hash FROM nodes WHERE node_id NOT LIKE 'p:%3'"
_BROKEN_E = "SELECT source, CASE WHEN ord % 1000 = 5 THEN source ELSE target END AS target, CASE WHEN ord % 500 = 7 THEN 'documented_by' ELSE type END AS type FROM edges"
_CHECKS = f"""WITH bn AS ({_BROKEN_N}), be AS ({_BROKEN_E}),
ch AS (SELECT DISTINCT 'dangling' AS "check", source || '->' || target AS item FROM be WHERE source NOT IN (SELECT node_id FROM bn) OR target NOT IN (SELECT node_id FROM bn)
UNION ALL SELECT 'self_loop', source || '->' || target FROM be WHERE source = target
UNION ALL SELECT 'bad_type', source || '->' || target || ':' || type FROM be WHERE type NOT IN ({quoted(schema.EDGE_TYPES)})
UNION ALL SELECT 'bad_hash', node_id FROM bn WHERE NOT regexp_full_match(hash, '[a-f0-9]{{40}}'))"""


@query(f"{_CHECKS} SELECT * FROM ch")
def graph_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the graph's invariants."""
    return E.violations(sql(spark, sf_dir, _BROKEN_N), sql(spark, sf_dir, _BROKEN_E))


@query(f'{_CHECKS} SELECT "check", count(*) AS n FROM ch GROUP BY 1')
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number of violations by check."""
    return E.report(E.violations(sql(spark, sf_dir, _BROKEN_N), sql(spark, sf_dir, _BROKEN_E)))


@query(f"WITH bn AS ({_BROKEN_N}), be AS ({_BROKEN_E}) SELECT source, target, type FROM be WHERE source <> target AND source IN (SELECT node_id FROM bn) AND target IN (SELECT node_id FROM bn)")
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without dangling ends and self-loops."""
    return E.valid(sql(spark, sf_dir, _BROKEN_E), sql(spark, sf_dir, _BROKEN_N)).select("source", "target", "type")


_COUNTED = "SELECT node_id, CAST(length(content) % 3 AS INT) AS n_entities FROM nodes WHERE node_id NOT LIKE 'p:%3' UNION ALL SELECT 'lonely', 0"


@query(
    f"""WITH bn AS ({_COUNTED}), be AS ({_BROKEN_E}) SELECT (SELECT count(*) FROM bn WHERE node_id NOT IN (SELECT source FROM be UNION SELECT target FROM be)) AS orphans,
(SELECT count(*) FROM be WHERE source NOT IN (SELECT node_id FROM bn) OR target NOT IN (SELECT node_id FROM bn)) AS dangling, (SELECT count(*) FROM be WHERE source = target) AS self_loops,
(SELECT count(*) FROM bn WHERE n_entities = 0) AS without_entities, (SELECT count(*) FROM bn WHERE n_entities = 0) > 0.5 * (SELECT count(*) FROM bn) AS mostly_bare"""
)
def build_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts that a build warns about."""
    return E.build_warnings(sql(spark, sf_dir, _COUNTED), sql(spark, sf_dir, _BROKEN_E))


@query(
    """WITH ok AS (SELECT * FROM symbols WHERE NOT (name = 'run' OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR ends_with(name, '_test') OR length(name) <= 1))
SELECT DISTINCT r.node_id AS source, d.node_id AS target, r.name AS symbol FROM ok r JOIN ok d ON r.name = d.name AND d.kind = 'definition' WHERE r.kind IN ('reference', 'call', 'import') AND r.node_id <> d.node_id"""
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References joined with definitions by symbol."""
    return E.reference_edges(model(spark, sf_dir, "symbols"))


@query(
    """WITH n AS (SELECT DISTINCT node_id, lower(name) AS name FROM names), z AS (SELECT node_id, count(*) AS k FROM n GROUP BY node_id),
b AS (SELECT x.node_id AS source, y.node_id AS target, count(*) AS c FROM n x JOIN n y ON x.name = y.name AND x.node_id < y.node_id GROUP BY 1, 2),
s AS (SELECT source, target, c / (a.k + z.k - c) AS score FROM b JOIN z a ON a.node_id = source JOIN z ON z.node_id = target)
SELECT source, target, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM s WHERE score > 0.2) WHERE r <= 5"""
)
def jaccard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic edges by shared names, the five best a node."""
    return E.jaccard_edges(model(spark, sf_dir, "names")).select("source", "target", rounded(F.col("score")).alias("score"), "rank")


_RESULTS = "SELECT o_custkey % 50 AS query_id, 'o:' || o_orderkey AS node_id FROM orders"


@query(
    f"""WITH re AS ({_RESULTS}), f AS (SELECT DISTINCT query_id, source AS node_id FROM re JOIN edges ON target = node_id WHERE type = 'conversation_references_code'),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS r FROM f WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.query_id = f.query_id AND re.node_id = f.node_id))
SELECT query_id, node_id, CAST(r AS INT) AS rank FROM k WHERE r <= 3"""
)
def enrich_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three conversations that refer to a query's results."""
    return E.enriched(sql(spark, sf_dir, _RESULTS), model(spark, sf_dir, "edges"))


_RETRIEVED = "SELECT CAST(p_partkey % 20 AS BIGINT) AS query_id, 'p:' || p_partkey AS node_id, 'src/' || lower(p_type) || '/x/' || p_partkey || '.py' AS path FROM part"
_DOCS = "SELECT 'd' || p_partkey AS node_id, 'src/' || lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN '/readme.md' WHEN 1 THEN '/x/__init__.py' ELSE '/x/overview.md' END AS path FROM part"


@query(
    f"""WITH re AS ({_RETRIEVED}), dc AS ({_DOCS}), pp AS (SELECT query_id, string_split(path, '/') AS s FROM re),
fo AS (SELECT DISTINCT query_id, array_to_string(s[1:len(s) - 1], '/') AS f FROM pp UNION SELECT query_id, array_to_string(s[1:len(s) - 2], '/') FROM pp),
hit AS (SELECT DISTINCT query_id, node_id, path FROM fo JOIN dc ON path = f || '/readme.md' OR path = f || '/__init__.py' OR path = f || '/overview.md'),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN contains(path, 'readme.md') THEN 0 WHEN contains(path, '__init__') THEN 1 ELSE 2 END, path, node_id) AS r FROM hit)
SELECT query_id, node_id, path, CAST(r AS INT) AS rank FROM rk WHERE r <= 5"""
)
def dir_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lifted from the folders above results."""
    return E.lifted(sql(spark, sf_dir, _RETRIEVED), sql(spark, sf_dir, _DOCS))


_NEW = "SELECT source, target, type, score + 0.05 AS score, ord FROM edges WHERE ord % 4 = 0"
_OLD = "SELECT source, target, type, score, ord FROM edges WHERE ord % 4 <> 0"
_RW = "SELECT 'p:' || p_partkey AS node_id FROM part WHERE p_partkey % 10 = 0"


@query(f"WITH nw AS ({_NEW}), od AS ({_OLD}), rw AS ({_RW}) SELECT source, target, type, ord FROM od WHERE source NOT IN (SELECT node_id FROM rw) AND target NOT IN (SELECT node_id FROM rw) UNION ALL SELECT source, target, type, ord FROM nw")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New edges with the old ones that touch no rewritten node."""
    return E.merged(sql(spark, sf_dir, _OLD), sql(spark, sf_dir, _NEW), sql(spark, sf_dir, _RW)).select("source", "target", "type", "ord")


_PLAN = "SELECT 'n' || p_partkey AS node, 'n' || (p_partkey // 3) AS \"on\" FROM part WHERE p_partkey > 0 UNION ALL SELECT 'x1', 'x2' UNION ALL SELECT 'x2', 'x1' UNION ALL SELECT 'x3', 'x1'"
_PLAN_SPARK = _PLAN.replace("(p_partkey // 3)", "(p_partkey DIV 3)").replace('"on"', "`on`")


@query(
    f"""WITH RECURSIVE pl AS ({_PLAN}), al AS (SELECT node FROM pl UNION SELECT "on" FROM pl),
lv(node, level) AS (SELECT node, 0 FROM al WHERE node NOT IN (SELECT node FROM pl) UNION SELECT pl.node, lv.level + 1 FROM lv JOIN pl ON pl."on" = lv.node WHERE lv.level < 100)
SELECT al.node, CAST(max(level) AS INT) AS level FROM al LEFT JOIN lv ON lv.node = al.node GROUP BY al.node"""
)
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological levels of a plan; nodes on a cycle have none."""
    d = sql(spark, sf_dir, _PLAN_SPARK)
    return G.topological_levels(d.select("node").union(d.select("on")), d)


_ASK = "SELECT id, CASE WHEN id % 4 = 0 THEN c ELSE c END AS s, p, o FROM (SELECT id, trim(replace(s, 'CUSTOMER', 'Customer')) AS c, p, o FROM asked)"


@query(
    f"""WITH ak AS ({_ASK}) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM triples t WHERE t.s = ak.s AND t.p = ak.p AND t.o = ak.o) THEN 'fact'
WHEN EXISTS (SELECT 1 FROM triples t JOIN triples u ON u.s = t.o WHERE t.s = ak.s AND u.o = ak.o) THEN 'inference' ELSE 'unsupported' END AS kind FROM ak"""
)
def fact_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, two-hop inferences and unsupported claims."""
    return G.claim_kind(sql(spark, sf_dir, _ASK), model(spark, sf_dir, "triples")).select("id", "kind")


_CITED = "SELECT id % 200 AS answer, CAST(id AS BIGINT) AS pos, trim(replace(s, 'CUSTOMER', 'Customer')) AS s, p, o FROM asked UNION ALL SELECT c_custkey % 200, 1000000 + c_custkey, n_name, 'in_region', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_GAPS = f"""WITH ci AS ({_CITED}), gp AS (SELECT answer, pos, EXISTS (SELECT 1 FROM triples t WHERE t.s = ci.s AND t.p = ci.p AND t.o = ci.o) AS in_graph, o = lead(s) OVER (PARTITION BY answer ORDER BY pos) AS adjacent FROM ci)"""


@query(f"{_GAPS} SELECT * FROM gp")
def path_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations outside the graph and breaks between them."""
    return G.citation_gaps(sql(spark, sf_dir, _CITED), model(spark, sf_dir, "triples")).select("answer", "pos", "in_graph", "adjacent")


@query(f"{_GAPS} SELECT answer, round(avg(CAST(in_graph AS INT)), 6) AS validity, round(coalesce(avg(CAST(adjacent AS INT)), 0), 6) AS adjacency FROM gp GROUP BY answer")
def path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cited edges that exist, and of neighbours that meet."""
    gaps = G.citation_gaps(sql(spark, sf_dir, _CITED), model(spark, sf_dir, "triples"))
    return gaps.groupBy("answer").agg(F.round(F.avg(F.col("in_graph").cast("int")), 6).alias("validity"), F.round(F.coalesce(F.avg(F.col("adjacent").cast("int")), F.lit(0.0)), 6).alias("adjacency"))


@query(
    f"""WITH RECURSIVE fl AS ({_FLOW}), pa(path, node) AS (SELECT [node], node FROM ({_SRC}) UNION SELECT list_append(pa.path, fl.target), fl.target FROM pa JOIN fl ON fl.source = pa.node WHERE len(pa.path) <= 3 AND NOT list_contains(pa.path, fl.target)),
pp AS (SELECT path FROM pa WHERE len(path) > 1 AND node IN (SELECT node FROM ({_SINK}))), st AS (SELECT DISTINCT unnest(path[1:len(path) - 1]) AS a, unnest(path[2:]) AS b FROM pp),
nm AS (SELECT st.*, replace(coalesce(x.title, substr(a, 1, 8)), '"', '''') AS al, replace(coalesce(y.title, substr(b, 1, 8)), '"', '''') AS bl FROM st LEFT JOIN nodes x ON x.node_id = a LEFT JOIN nodes y ON y.node_id = b)
SELECT CASE WHEN count(*) = 0 THEN 'graph TD' || chr(10) || '  A[No paths found]' ELSE 'graph TD' || chr(10) || string_agg('  ' || substr(a, 1, 8) || '["' || al || '"] --> ' || substr(b, 1, 8) || '["' || bl || '"]', chr(10) ORDER BY a, b) END AS graph FROM nm"""
)
def flow_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths' steps as a Mermaid graph."""
    paths = G.simple_paths(sql(spark, sf_dir, _SRC), sql(spark, sf_dir, _SINK), sql(spark, sf_dir, _FLOW), 3)
    return G.mermaid(paths, model(spark, sf_dir, "nodes").select(F.col("node_id").alias("node"), F.col("title").alias("label")))


@query(
    """WITH RECURSIVE ed AS (SELECT DISTINCT caller AS source, callee AS target FROM calls WHERE caller <> callee AND callee LIKE 'method%'),
pa(path, node) AS (SELECT ['method_5'], 'method_5' UNION SELECT list_append(path, target), target FROM pa JOIN ed ON source = node WHERE len(path) <= 3 AND NOT list_contains(path, target))
SELECT array_to_string(path, ' > ') AS chain FROM pa WHERE len(path) > 1 AND node IN (SELECT 'method_' || (c_custkey % 40) FROM customer)"""
)
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call chains from one method to some others."""
    e = model(spark, sf_dir, "calls").filter("caller <> callee AND callee LIKE 'method%'").select(F.col("caller").alias("source"), F.col("callee").alias("target"))
    ends = sql(spark, sf_dir, "SELECT DISTINCT 'method_' || (c_custkey % 40) AS node FROM customer")
    return G.simple_paths(spark.sql("SELECT 'method_5' AS node"), ends, e, 3).select(F.array_join("path", " > ").alias("chain"))


_TRADE = """SELECT source, target FROM edges WHERE type = 'hierarchy' AND (source LIKE 's:%' OR source LIKE 'n:%') UNION ALL SELECT 's:' || s_suppkey, 's:' || (s_suppkey * 7 % 97 + 1) FROM supplier"""


@query(
    f"""WITH RECURSIVE ed AS ({_TRADE}), e2 AS (SELECT source AS a, target AS b FROM ed WHERE source <> target UNION SELECT target, source FROM ed WHERE source <> target), nd AS (SELECT DISTINCT a AS node FROM e2), nn AS (SELECT count(*) AS n FROM nd),
wa(s, v, h) AS (SELECT node, node, 0 FROM nd UNION SELECT s, b, h + 1 FROM wa JOIN e2 ON a = v WHERE h < 10), di AS (SELECT s, v, min(h) AS d FROM wa GROUP BY s, v),
sg(h, s, v, c) AS (SELECT 0, node, node, CAST(1 AS DOUBLE) FROM nd UNION ALL SELECT h + 1, sg.s, b, sum(c) FROM sg JOIN e2 ON a = sg.v JOIN di ON di.s = sg.s AND di.v = b AND di.d = h + 1 WHERE h < 10 GROUP BY h, sg.s, b),
sh AS (SELECT x.v AS node, x.s, sum(x.c * y.c / z.c) AS share FROM sg x JOIN sg y ON y.s = x.v JOIN sg z ON z.s = x.s AND z.v = y.v AND z.h = x.h + y.h WHERE x.v <> x.s AND x.v <> y.v GROUP BY x.v, x.s),
ex AS (SELECT node, sum(share) AS t FROM sh GROUP BY node), sp AS (SELECT node, sum(share) AS t FROM sh WHERE s LIKE '%0' OR s LIKE '%5' GROUP BY node), pv AS (SELECT count(*) AS p FROM nd WHERE node LIKE '%0' OR node LIKE '%5')
SELECT nd.node, round(coalesce(ex.t, 0) / ((n - 1) * (n - 2)), 6) AS exact, round(coalesce(sp.t, 0) * n / p / ((n - 1) * (n - 2)), 6) AS sampled FROM nd LEFT JOIN ex ON ex.node = nd.node LEFT JOIN sp ON sp.node = nd.node, nn, pv"""
)
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of suppliers, nations and regions, from all nodes and from pivots."""
    edges = sql(spark, sf_dir, _TRADE)
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    exact = B.betweenness(edges, pivots=ends).select("node", F.round("betweenness", 6).alias("exact"))
    return exact.join(B.betweenness(edges, pivots=ends.filter("node LIKE '%0' OR node LIKE '%5'")).select("node", F.round("betweenness", 6).alias("sampled")), "node")
