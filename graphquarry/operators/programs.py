"""Code-property graphs as tables: cpg_nodes (schema.CPG_NODES) and cpg_edges (schema.CPG_EDGES).

Labels: METHOD, CALL, LITERAL, IDENTIFIER, LOCAL, METHOD_PARAMETER_IN, CONTROL_STRUCTURE, TYPE_DECL, COMMENT, TAG, ANNOTATION,
IMPORT, FILE, NAMESPACE.  Edges run from container to contained (AST), caller to callee (CALL), definition to use
(REACHING_DEF), along control flow (CFG) and control dependence (CDG), and from derived to base (INHERITS_FROM).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions import words
from ..plans.materialise import broadcast_within, cut
from .graph import reachable, shortest_paths


def labelled(nodes: DataFrame, label: str, pattern: str | None = None, field: str = "name") -> DataFrame:
    """Nodes of a label whose field matches a pattern (C11, C13, C14, C16 by label)."""
    own = nodes.filter(F.col("label") == label)
    return own if pattern is None else own.filter(F.col(field).rlike(pattern))


def contained(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(method, node..) nodes of a label under each method, at any AST depth is flattened by the exporter to one edge."""
    ast = edges.filter("label = 'AST'").select("src", "dst")
    m = nodes.filter("label = 'METHOD'").select(F.col("id").alias("src"), F.col("name").alias("method"))
    return nodes.filter(F.col("label") == label).join(ast, F.col("id") == F.col("dst")).join(m, "src").drop("src", "dst")


def names_of(nodes: DataFrame, label: str) -> DataFrame:
    """(name): distinct names of a label, sentinels aside, in order."""
    return labelled(nodes, label).select("name").filter(~F.col("name").startswith("<")).distinct().orderBy("name")


def callers(edges: DataFrame, method: str) -> DataFrame:
    """(callee, callers): who calls the methods of a name."""
    return edges.filter(F.col("callee") == method).groupBy("callee").agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def dead_code(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """Named methods that nothing calls."""
    return methods.filter(~F.col("name").startswith("<")).join(calls.select(F.col("callee").alias("name")).distinct(), "name", "left_anti")


def recursion(calls: DataFrame) -> DataFrame:
    """(a, b, kind): methods that call themselves, and pairs that call each other."""
    pairs = calls.select("caller", "callee").distinct()
    direct = pairs.filter("caller = callee").select(F.col("caller").alias("a"), F.col("callee").alias("b"), F.lit("direct").alias("kind"))
    back = pairs.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    mutual = pairs.filter("caller < callee").join(back, ["caller", "callee"], "left_semi").select(F.col("caller").alias("a"), F.col("callee").alias("b"), F.lit("mutual").alias("kind"))
    return direct.unionByName(mutual)


def call_graph_stats(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: methods, calls, entry points (never called), leaves (never calling), valid."""
    m = methods.select("name").distinct()
    called, calling = calls.select(F.col("callee").alias("name")).distinct().withColumn("c", F.lit(1)), calls.select(F.col("caller").alias("name")).distinct().withColumn("d", F.lit(1))
    by = m.join(called, "name", "left").join(calling, "name", "left").agg(F.count(F.lit(1)).alias("methods"), F.count_if(F.col("c").isNull()).alias("entry_points"), F.count_if(F.col("d").isNull()).alias("leaves"), F.lit(1).alias("one"))
    n = calls.agg(F.count(F.lit(1)).alias("calls"), F.lit(1).alias("one"))
    return by.join(n, "one").select("methods", "calls", "entry_points", "leaves", (F.col("methods") > 0).alias("valid"))


def complexity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, loops, ifs, complexity, rating): control structures plus one; low under 5, medium under 10."""
    inside = contained(nodes, edges, "CONTROL_STRUCTURE").groupBy("method").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("name").isin("FOR", "WHILE", "DO")).alias("loops"), F.count_if(F.col("name") == "IF").alias("ifs"))
    every = nodes.filter("label = 'METHOD'").select(F.col("name").alias("method")).distinct().join(inside, "method", "left")
    n = F.coalesce("k", F.lit(0)) + 1
    return every.select("method", F.coalesce("loops", F.lit(0)).alias("loops"), F.coalesce("ifs", F.lit(0)).alias("ifs"), n.alias("complexity"), F.when(n < 5, "low").when(n < 10, "medium").otherwise("high").alias("rating"))


def hierarchy(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(type, relation): base and derived types of a type."""
    t = nodes.filter("label = 'TYPE_DECL'").select("id", "name")
    pairs = edges.filter("label = 'INHERITS_FROM'").join(t.select(F.col("id").alias("src"), F.col("name").alias("derived")), "src").join(t.select(F.col("id").alias("dst"), F.col("name").alias("base")), "dst")
    up = pairs.filter(F.col("derived") == name).select(F.col("base").alias("type"), F.lit("base").alias("relation"))
    return up.union(pairs.filter(F.col("base") == name).select("derived", F.lit("derived"))).distinct()


def backward_slice(nodes: DataFrame, edges: DataFrame, variable: str, hops: int = 10) -> DataFrame:
    """(id, depth): what reaches the uses of a variable over data and control dependence, uses at depth 0."""
    uses = labelled(nodes, "IDENTIFIER").filter(F.col("name") == variable).select(F.col("id").alias("node"))
    back = edges.filter("label IN ('REACHING_DEF', 'CDG')").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return reachable(uses, back, hops).select(F.col("node").alias("id"), "depth")


def dot(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(method, dot): the edges of a label within each method as a DOT graph."""
    within = edges.filter("label = 'AST'").select(F.col("src").alias("m"), F.col("dst").alias("x"))
    own = edges.filter(F.col("label") == label).select("src", "dst")
    inside = own.join(within.select("m", F.col("x").alias("src")), "src").join(within.select("m", F.col("x").alias("dst")), ["m", "dst"])
    m = nodes.filter("label = 'METHOD'").select(F.col("id").alias("m"), F.col("name").alias("method"))
    line = F.format_string('  "%s" -> "%s"', "src", "dst")
    lines = inside.join(m, "m").groupBy("method").agg(F.array_sort(F.collect_set(line)).alias("l"))
    return lines.select("method", F.concat(F.lit(f"digraph {label} {{\n"), F.array_join("l", "\n"), F.lit("\n}")).alias("dot"))


def policy_violations(nodes: DataFrame, edges: DataFrame, least: str = "info", hops: int = 10) -> DataFrame:
    """(policy, severity, cwe, id, location): nodes that break a policy of at least a severity.

    The policies are a fixed list; each is a filter, some with a path of definitions from a parameter.
    """
    argument = edges.filter("label = 'AST'").select(F.col("src").alias("call"), F.col("dst").alias("arg")).join(nodes.select(F.col("id").alias("arg"), F.col("code").alias("arg_code")), "arg")
    tainted = None
    found = None
    for name, severity, cwe, label, pattern, on_code, from_parameter in words.POLICIES:
        if schema.SEVERITY_RANK[severity] < schema.SEVERITY_RANK[least]:
            continue
        hits = labelled(nodes, label, pattern or None)
        if on_code and label == "LITERAL":
            hits = hits.filter(F.col("code").rlike(on_code))
        elif on_code:
            hits = hits.join(argument.filter(F.col("arg_code").rlike(on_code)).select(F.col("call").alias("id")).distinct(), "id", "left_semi")
        if from_parameter:
            if tainted is None:
                flow = edges.filter("label = 'REACHING_DEF'").select("src", "dst").distinct()
                parameters = labelled(nodes, "METHOD_PARAMETER_IN").select(F.col("id").alias("node"))
                reached = reachable(parameters, flow, hops).select(F.col("node").alias("arg"))
                tainted = argument.join(reached, "arg", "left_semi").select(F.col("call").alias("id")).distinct()
            hits = hits.join(tainted, "id", "left_semi")
        rows = hits.select(F.lit(name).alias("policy"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe"), "id", location(F.col("filename"), F.col("line")).alias("location"))
        found = rows if found is None else found.unionByName(rows)
    return found


def location(filename: Column, line: Column) -> Column:
    return F.coalesce(F.when(line.isNotNull(), F.concat_ws(":", filename, line.cast("string"))), filename, F.lit("unknown"))


def severity_order(df: DataFrame, k: int) -> DataFrame:
    """The k gravest rows: severity, then confidence, then id."""
    rank = F.create_map(*[F.lit(x) for kv in schema.SEVERITY_RANK.items() for x in kv])[F.lower("severity")]
    return df.orderBy(F.desc(rank), F.desc("confidence"), "id").limit(k)


def catalogue() -> list[tuple[int, str, str, str, str, str]]:
    """(order, kind, cwe, severity, side, pattern) of all vulnerability patterns."""
    return [(i, kind, cwe, severity, side, p) for i, (kind, cwe, severity, sources, sinks) in enumerate(words.VULNERABILITIES) for side, ps in (("source", sources), ("sink", sinks)) for p in ps]


def pattern_matches(nodes: DataFrame) -> DataFrame:
    """(node_id, kind, cwe, severity, side, pattern): each vulnerability pattern in the lower-cased content of each node."""
    every = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(cwe).alias("cwe"), F.lit(grave).alias("severity"), F.lit(side).alias("side"), F.lit(p).alias("pattern")) for _, kind, cwe, grave, side, p in catalogue()])
    return nodes.select("node_id", F.inline(F.filter(every, lambda v: F.contains(F.lower("content"), F.lower(v["pattern"])))))


def pattern_nodes(nodes: DataFrame, side: str) -> DataFrame:
    """(node): nodes whose lower-cased content has any source or sink pattern."""
    parts = sorted({p.lower() for *_, s, p in catalogue() if s == side})
    return nodes.filter(T.any_in(F.lower("content"), parts)).select(F.col("node_id").alias("node"))


def sink_kind(content: Column) -> tuple[Column, Column]:
    """(kind, severity) of the first vulnerability in order of precedence with a sink in the content."""
    low = F.lower(content)
    kind = severity = None
    for name, _, grave, _, sinks in words.VULNERABILITIES:
        hit = T.any_in(low, [s.lower() for s in sinks])
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        severity = F.when(hit, grave) if severity is None else severity.when(hit, grave)
    return kind.otherwise("Unknown"), severity.otherwise("Medium")


def taint_paths(nodes: DataFrame, edges: DataFrame, cutoff: int = 10) -> DataFrame:
    """(source, sink, path, kind, severity, confidence): the shortest data-flow path (ties: the least) of each pair."""
    best = shortest_paths(pattern_nodes(nodes, "source"), pattern_nodes(nodes, "sink"), edges.filter("type = 'data_flow'"), cutoff)
    kind, severity = sink_kind(F.col("content"))
    sure = F.round(F.greatest(F.lit(0.0), 1.0 - 0.1 * (F.size("path") - 2)), 2)
    return best.join(nodes.select(F.col("node_id").alias("sink"), "content"), "sink").select("source", "sink", "path", kind.alias("kind"), severity.alias("severity"), sure.alias("confidence"))


def located(places: DataFrame, nodes: DataFrame, small: int = 10_000) -> DataFrame:
    """(place_id, node_id): nodes at (file, line), by equal path, else by a path that ends with the file.

    The fallback has no equi-join on the whole path, so it joins on the file's name first.
    """
    inside = (F.col("line") >= F.col("line_start")) & (F.col("line") <= F.col("line_end"))
    exact = places.join(nodes, (F.col("file") == F.col("path")) & inside).select("place_id", "node_id")
    left = places.join(exact.select("place_id").distinct(), "place_id", "left_anti")
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    loose = left.withColumn("k", name("file")).join(nodes.withColumn("k", name("path")), "k").filter(inside & F.endswith("path", F.col("file"))).select("place_id", "node_id")
    return exact.unionByName(loose).groupBy("place_id").agg(F.min("node_id").alias("node_id"))


def tainted_candidates(methods: DataFrame, sources: str, sinks: str, most: int = 10) -> DataFrame:
    """(source, sink): the first `most` methods named like sources against the first named like sinks, unverified."""
    pick = lambda pattern, c: methods.filter(F.col("name").rlike(pattern)).select(F.col("name").alias(c)).distinct().orderBy(c).limit(most)
    return pick(sources, "source").join(F.broadcast(pick(sinks, "sink")), F.lit(True)).filter("source <> sink")


def cpg_entities(nodes: DataFrame) -> DataFrame:
    """(name, type): CPG nodes as definitions, calls, references and imports, each once."""
    kind = F.when(F.col("label") == "METHOD", "definition").when(F.col("label") == "CALL", "call").when(F.col("label").isin("IDENTIFIER", "LOCAL"), "reference").when(F.col("label") == "IMPORT", "import")
    return nodes.select("name", kind.alias("type")).filter("type IS NOT NULL").distinct()


def unused_parameters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, name): parameters that no identifier of their method has the name of."""
    used = contained(nodes, edges, "IDENTIFIER").select("method", "name").distinct()
    return contained(nodes, edges, "METHOD_PARAMETER_IN").select("method", "name").join(used, ["method", "name"], "left_anti")


def once_each(tables: list[DataFrame], work: Callable[..., DataFrame], small: int = 200_000) -> DataFrame:
    """work(*tables), which has a column method and looks at one method at a time, done once for all methods whose rows are equal.

    Methods are alike if the number of their rows in the tables (method, ..) and the sums of four 32-bit parts of the rows' hashes are equal,
    so no method's rows are gathered to compare them.
    """
    marks = None
    for i, t in enumerate(tables):
        own = [F.col(c) for c in t.columns if c != "method"]
        h, g = (F.xxhash64(F.lit(seed), *own, *[c.isNull() for c in own]) for seed in (2 * i, 2 * i + 1))
        rows = t.select("method", h.alias("h"), g.alias("g"))
        marks = rows if marks is None else marks.unionByName(rows)
    low, high = lambda c: F.sum(F.col(c).bitwiseAND(0xFFFFFFFF)), lambda c: F.sum(F.shiftrightunsigned(c, 32))
    bodies = cut(marks.groupBy("method").agg(F.struct(F.count(F.lit(1)).alias("n"), low("h").alias("a"), high("h").alias("b"), low("g").alias("c"), high("g").alias("d")).alias("body")))
    firsts = cut(bodies.groupBy("body").agg(F.min("method").alias("first")))
    first = broadcast_within(firsts.select("first"), small)
    done = work(*[cut(t.join(first, F.col("method").eqNullSafe(F.col("first"))).select(*t.columns)) for t in tables])
    columns = [c for c in done.columns if c != "method"]
    found = cut(done.join(firsts, F.col("method").eqNullSafe(F.col("first"))).select("body", *columns))
    return bodies.join(broadcast_within(found, small), "body").select("method", *columns)


def dominators(cfg: DataFrame, entry: str, post: bool = False) -> DataFrame:
    """(method, node, dominator, immediate): dominators over each method's control flow; unreachable nodes are left out.

    cfg: (method, src, dst).  Equal graphs are solved once; the graph of one method is a row of work: its size is that of a method.  With
    post, edges are turned round and `entry` is the exit.  A node dominates itself.
    """
    return once_each([cfg.select("method", "src", "dst")], lambda c: _dominators(c, entry, post))


def _dominators(cfg: DataFrame, entry: str, post: bool = False) -> DataFrame:
    def solve(flow: list) -> list[tuple[str, str, bool]]:
        follow: dict[str, list[str]] = {}
        before: dict[str, list[str]] = {}
        for e in flow:
            s, d = (e["dst"], e["src"]) if post else (e["src"], e["dst"])
            follow.setdefault(s, []).append(d)
            before.setdefault(d, []).append(s)
        order, seen, stack = [], {entry}, [(entry, iter(follow.get(entry, ())))]
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(follow.get(step, ()))))
        order.reverse()
        rank = {n: i for i, n in enumerate(order)}
        up = {entry: entry}
        changed = True
        while changed:
            changed = False
            for n in order[1:]:
                best = None
                for p in before.get(n, ()):
                    if p not in up:
                        continue
                    if best is None:
                        best = p
                        continue
                    a, b = p, best
                    while a != b:
                        while rank[a] > rank[b]:
                            a = up[a]
                        while rank[b] > rank[a]:
                            b = up[b]
                    best = a
                if up.get(n) != best:
                    up[n], changed = best, True
        rows = []
        for n in order:
            at = n
            while True:
                rows.append((n, at, n != entry and at == up[n]))
                if at == entry:
                    break
                at = up[at]
        return rows

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(m, *r) for m, flow in zip(part["method"], part["flow"], strict=True) for r in solve(flow)]
            yield pd.DataFrame(rows, columns=["method", "node", "dominator", "immediate"])

    flows = cfg.groupBy("method").agg(F.collect_list(F.struct("src", "dst")).alias("flow"))
    return flows.mapInPandas(batches, "method string, node string, dominator string, immediate boolean")


def control_dependences(cfg: DataFrame, exit_: str) -> DataFrame:
    """(method, node, on): nodes that run or not by a branch's outcome: those that post-dominate one successor of the
    branch but not the branch itself.  Equal graphs are solved once."""
    return once_each([cfg.select("method", "src", "dst")], lambda c: _control_dependences(c, exit_))


def _control_dependences(cfg: DataFrame, exit_: str) -> DataFrame:
    post = cut(_dominators(cfg, exit_, post=True)).select("method", F.col("node").alias("n"), F.col("dominator").alias("d"))
    near = cfg.join(post, (cfg.method == post.method) & (cfg.dst == post.n)).select(cfg.method, F.col("src").alias("on"), F.col("d").alias("node"))
    own = post.filter("n <> d").select("method", F.col("n").alias("on"), F.col("d").alias("node"))
    return near.distinct().join(own, ["method", "on", "node"], "left_anti")


def reaching_definitions(cfg: DataFrame, facts: DataFrame, small: int = 200_000) -> DataFrame:
    """(method, src, dst, var): data dependences, of cfg (method, src, dst) and facts (method, node, var, kind: def or use).

    A definition goes along control flow up to the nodes that define its variable anew, which it still reaches; all
    definitions of all methods go one step at a time until none reaches a new node.  Equal methods are solved once.
    """
    return once_each([cfg.select("method", "src", "dst"), facts.select("method", "node", "var", "kind")], lambda c, f: _reaching_definitions(c, f, small), small)


def _reaching_definitions(cfg: DataFrame, facts: DataFrame, small: int = 200_000) -> DataFrame:
    defs = cut(facts.filter("kind = 'def'").select("method", "node", "var").distinct())
    flow = cfg.select(F.col("method").alias("m"), F.col("src").alias("at"), "dst")
    kills = defs.select(F.col("method").alias("m"), F.col("node").alias("at"), F.col("var").alias("v"))
    step = lambda df: flow.join(broadcast_within(df, small), (F.col("m") == F.col("method")) & (F.col("at") == F.col("node"))).select("method", "var", "def", F.col("dst").alias("node")).distinct()
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  a union trips over constraints that a checkpoint keeps on columns it dropped
    frontier = seen = fresh(cut(step(defs.withColumn("def", F.col("node")))))
    while frontier.limit(1).count():
        on = cut(frontier.join(kills, (F.col("m") == F.col("method")) & (F.col("at") == F.col("node")) & (F.col("v") == F.col("var")), "left_anti"))
        known = seen.select(*[F.col(c).alias(f"known_{c}") for c in seen.columns])
        near = step(on)
        frontier = fresh(cut(near.join(known, [F.col(c) == F.col(f"known_{c}") for c in near.columns], "left_anti")))
        seen = seen.unionByName(frontier)
    uses = facts.filter("kind = 'use'").select("method", "node", "var").distinct()
    return seen.join(uses, ["method", "node", "var"]).select("method", F.col("def").alias("src"), F.col("node").alias("dst"), "var")


def program_dependences(cfg: DataFrame, facts: DataFrame, exit_: str) -> DataFrame:
    """(method, src, dst, label): data dependences (DDG) and control dependences (CDG) of each method.  Equal methods are solved once."""
    return once_each([cfg.select("method", "src", "dst"), facts.select("method", "node", "var", "kind")], lambda c, f: _program_dependences(c, f, exit_))


def _program_dependences(cfg: DataFrame, facts: DataFrame, exit_: str) -> DataFrame:
    data = _reaching_definitions(cfg, facts).select("method", "src", "dst", F.lit("DDG").alias("label")).distinct()
    return data.unionByName(_control_dependences(cfg, exit_).select("method", F.col("on").alias("src"), F.col("node").alias("dst"), F.lit("CDG").alias("label")))


def dependence_slice(dependences: DataFrame, facts: DataFrame, variable: str, hops: int = 10) -> DataFrame:
    """(method, node, depth): what the uses of a variable depend on within their method, uses at depth 0."""
    at = lambda c: F.struct("method", F.col(c).alias("node"))
    uses = facts.filter("kind = 'use'").filter(F.col("var") == variable).select(at("node").alias("node"))
    back = cut(dependences.select(at("dst").alias("src"), at("src").alias("dst")).distinct())  # made once, walked hop by hop
    return reachable(uses, back, hops).select("node.method", "node.node", "depth")


def dot_of(edges: DataFrame) -> DataFrame:
    """(method, label, dot): edges (method, src, dst, label) of each method and label as a DOT graph."""
    line = F.format_string('  "%s" -> "%s"', "src", "dst")
    lines = edges.groupBy("method", "label").agg(F.array_sort(F.collect_set(line)).alias("l"))
    return lines.select("method", "label", F.concat(F.lit("digraph "), "label", F.lit(" {\n"), F.array_join("l", "\n"), F.lit("\n}")).alias("dot"))


def name_edges(links: DataFrame, definitions: DataFrame, small: int = 200_000) -> DataFrame:
    """(source, target): links between names as links between ids; the first definition (least ord) of a name counts."""
    first = definitions.groupBy("name").agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
    return links.join(first.select(F.col("name").alias("caller"), F.col("id").alias("source")), "caller").join(first.select(F.col("name").alias("callee"), F.col("id").alias("target")), "callee").select("source", "target").distinct()


