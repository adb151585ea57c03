"""Operators that SQL cannot express, against plain Python and worked examples."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphquarry.functions import text as T
from graphquarry.operators import chunking, claims, context, edges, graph, retrieval, unitizer
from graphquarry.operators.components import connected_components
from graphquarry.plans import index
from graphquarry.sources import conversations, files, store
from graphquarry.streaming import mentions


def test_index_example(spark):
    posts = spark.createDataFrame([("1", "apple", 2), ("1", "banana", 1), ("2", "banana", 3), ("2", "cherry", 1)], "doc_id string, term string, tf int")
    stats = spark.createDataFrame([("1", 3), ("2", 4)], "doc_id string, doc_len long")
    assert retrieval.corpus_stats(stats).first().avgdl == 3.5
    q = spark.createDataFrame([(0, "banana")], "query_id int, term string")
    assert [r.doc_id for r in retrieval.top_k(retrieval.bm25(q, posts, stats), 2).orderBy("rank").collect()] == ["2", "1"]


def test_chain_traversal(spark):
    e = spark.createDataFrame([("A", "B", "semantic"), ("B", "C", "semantic")], "source string, target string, type string")
    start = spark.createDataFrame([("A",)], "node string")
    reach = lambda how, hops, s=start: {r.node for r in graph.reachable(s, graph.adjacency(e, how), hops).collect()}
    assert reach("forward", 2) == {"A", "B", "C"} and reach("forward", 1) == {"A", "B"}
    assert reach("reverse", 1, spark.createDataFrame([("B",)], "node string")) == {"B", "A"}


@pytest.mark.parametrize("seed", range(3))
def test_random_traversals(spark, seed):
    rng = random.Random(3000 + seed)
    kinds = ("reference", "semantic", "call", "supersedes", "contradicts", "ast")
    rows = [(str(rng.randrange(12)), str(rng.randrange(12)), rng.choice(kinds)) for _ in range(rng.randrange(10, 26))]
    follow = defaultdict(set)
    for s, t, k in rows:
        if k not in ("supersedes", "contradicts"):
            follow[s].add(t)
            if k in ("semantic", "ast"):
                follow[t].add(s)
    want, frontier = {"0"}, {"0"}
    for _ in range(3):
        frontier = {t for s in frontier for t in follow[s]} - want
        want |= frontier
    e = spark.createDataFrame(rows, "source string, target string, type string")
    assert {r.node for r in graph.reachable(spark.createDataFrame([("0",)], "node string"), graph.adjacency(e), 3).collect()} == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = connected_components(chain.union(spark.createDataFrame([(1000, 1001)], "a long, b long")), "a", "b").collect()
    assert Counter(r.component for r in out) == {0: 301, 1000: 2}
    assert connected_components(chain.limit(0), "a", "b").count() == 0


def brute_centralities(pairs):
    nodes = sorted({x for p in pairs for x in p[:2]})
    weight = {}
    for a, b, w in pairs:
        weight[a, b] = weight[b, a] = w
    routes = {}
    for s, t in itertools.permutations(nodes, 2):
        found = []

        def walk(path, d):
            if path[-1] == t:  # noqa: B023
                found.append((d, tuple(path)))  # noqa: B023
                return
            for n in nodes:
                if (path[-1], n) in weight and n not in path:
                    walk([*path, n], d + weight[path[-1], n])

        walk([s], 0.0)
        if found:
            best = min(d for d, _ in found)
            routes[s, t] = (best, [p for d, p in found if abs(d - best) < 1e-12])
    between, close = {}, {}
    for v in nodes:
        part = {v} | {t for t in nodes if (v, t) in routes}
        n = len(part)
        close[v] = (n - 1) / sum(routes[v, t][0] for t in part if t != v)
        total = sum(sum(v in p[1:-1] for p in ps) / len(ps) for (s, t), (_, ps) in routes.items() if v not in (s, t))
        between[v] = total / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return between, close


@pytest.mark.parametrize("seed", range(4))
def test_centralities(seed):
    rng = random.Random(seed)
    pairs = {}
    for _ in range(9):
        a, b = rng.sample("abcdefg", 2)
        pairs[min(a, b), max(a, b)] = rng.choice([0.5, 1.0, 1.5])
    rows = [(a, b, w) for (a, b), w in pairs.items()]
    between, close = brute_centralities(rows)
    out = context.centralities(rows).set_index("node")
    for v in between:
        assert out.betweenness[v] == pytest.approx(between[v]) and out.closeness[v] == pytest.approx(close[v])


def test_centrality_of_pairs():
    out = context.centralities([("a", "b", 1.0), ("c", "d", 2.0)])
    assert len(out) == 4 and (out.degree == 1.0).all()
    assert len(context.centralities([])) == 0


@pytest.mark.parametrize("n", [3, 75, 76, 200])
def test_eigenvectors_do_not_depend_on_a_number_of_steps(n):
    chain = [(f"{i:03d}", f"{i + 1:03d}", 1.5) for i in range(1, n)]
    out = context.centralities(chain).set_index("node")
    want = [math.sin(math.pi * i / (n + 1)) * math.sqrt(2 / (n + 1)) for i in range(1, n + 1)]
    assert [out.eigenvector[f"{i:03d}"] for i in range(1, n + 1)] == pytest.approx(want)


def test_eigenvectors_of_odd_weights():
    assert list(context.centralities([("a", "b", 0.0)]).eigenvector) == pytest.approx([math.sqrt(0.5)] * 2)
    assert list(context.leading(context.np.array([[0.0, math.nan], [math.nan, 0.0]]))) == [0.0, 0.0]


def test_path_quality():
    e = [("a", "b", "reference"), ("b", "c", "semantic"), ("d", "a", "reference"), ("c", "x", "supersedes")]
    q = context.path_qualities(["a"], e)
    assert q == {"a": 1.0, "b": pytest.approx(0.2 + 0.5 + 0.27), "c": pytest.approx(0.2 + 0.25 + 0.24)}


def test_greedy_pack():
    blocks = [("a", "f", 0.9, 40), ("b", "f", 0.1, 30), ("c", "g", 0.8, 50), ("d", "h", 0.7, 5), ("e", "h", 0.6, 80)]
    # a and its sibling b, then c does not fit 100 any more, d is a stub beside e and waits, e does not fit, d fills up.
    assert context.greedy_pack(blocks, 100) == ["a", "b", "d"]
    assert context.greedy_pack(blocks, 1000) == ["a", "b", "c", "e", "d"]
    assert context.greedy_pack(blocks, 0) == []


GOLDEN = [
    (
        ["Nova Dynamics, the robotics firm, negotiates supply agreements with Quantum Materials.", "Quantum Materials coordinates delivery logistics with Nova Dynamics and licenses battery patents to Meridian Labs.", "Meridian Labs provides laboratory services to Quantum Materials while managing warranty claims for Atlas.", "Atlas generates maintenance reports for Meridian Labs and streams telemetry to Quantum Materials.", "Nova Dynamics maintains a joint testing facility in Denver and Quantum Materials maintains a warehouse in Denver."],
        ["Nova Dynamics, the robotics firm, negotiates supply agreements with Quantum Materials.", "Quantum Materials coordinates delivery logistics with Nova Dynamics.", "Quantum Materials licenses battery patents to Meridian Labs.", "Meridian Labs provides laboratory services to Quantum Materials.", "Meridian Labs manages warranty claims for Atlas.", "Atlas generates maintenance reports for Meridian Labs.", "Atlas streams telemetry to Quantum Materials.", "Nova Dynamics maintains a joint testing facility in Denver.", "Quantum Materials maintains a warehouse in Denver."],
    ),
    (
        ["Helios Systems negotiates supply agreements with Vertex Robotics and Northwind Labs.", "Albion Energy negotiates supply agreements with Helios Systems, Vertex Robotics, and Northwind Labs."],
        ["Helios Systems negotiates supply agreements with Vertex Robotics.", "Helios Systems negotiates supply agreements with Northwind Labs.", "Albion Energy negotiates supply agreements with Helios Systems.", "Albion Energy negotiates supply agreements with Vertex Robotics.", "Albion Energy negotiates supply agreements with Northwind Labs."],
    ),
    (
        ["Helios Systems supplies batteries and control units to Quantum Materials.", "Quantum Materials licenses its solid-state cells and sodium packs to Helios Systems."],
        ["Helios Systems supplies batteries to Quantum Materials.", "Helios Systems supplies control units to Quantum Materials.", "Quantum Materials licenses its solid-state cells to Helios Systems.", "Quantum Materials licenses sodium packs to Helios Systems."],
    ),
]


@pytest.mark.parametrize("case", range(3))
def test_units(case):
    sentences, want = GOLDEN[case]
    units, facts = unitizer.unitize(sentences)
    assert units == want and facts == []


def test_units_of_a_profile():
    text = "Nova Dynamics is a robotics company founded in 2018. The company is headquartered in Austin, Texas. Dr. Lena Ortiz has been the CEO of Nova Dynamics since 2021. Its flagship product is the Atlas robotic arm, released in 2022.\nA related firm, Quantum Materials, supplies batteries to Nova Dynamics. Quantum Materials was founded in 2015 and is led by CEO Rajesh Patel."
    sentences = unitizer.split_sentences(text)
    assert len(sentences) == 6 and sentences[2].startswith("Dr. Lena Ortiz")
    units, facts = unitizer.unitize(sentences)
    assert len(units) == 10 and units[3] == "Dr. Lena Ortiz is the CEO of Nova Dynamics." and units[-1] == "Rajesh Patel leads Quantum Materials."
    assert ("Nova Dynamics", "founded_in", "2018") in facts and ("Dr. Lena Ortiz", "ceo_since", "2021") in facts and len(facts) == 6
    assert unitizer.split_sentences(None) == [] and unitizer.unitize([]) == ([], [])
    assert unitizer.objects("A, B, and C") == ["A", "B", "C"] and unitizer.objects("A and B") == ["A", "B"] and unitizer.objects("A") == ["A"]


def test_chunks():
    section = lambda n, text, level=1: {"level": level, "header": f"h{n}", "header_path": f"h{n}", "content": text, "line_start": n, "line_end": n + 1, "has_code": False}
    whole = chunking.chunk_sections([section(1, "a b c")], least=0)
    assert [(c.content, c.tokens, c.chunk_id) for c in whole] == [("# h1\n\na b c", 5, None)]
    split = chunking.chunk_sections([section(1, "\n\n".join(["x" * 40] * 5))], most=100, overlap_tokens=2, least=0)
    assert [c.header for c in split] == [f"h1 (part {i + 1})" for i in range(len(split))] and split[0].chunk_id == "h1_0" and len(split) > 2
    assert split[0].content.startswith("x" * 8 + "\n\n...\n\n# h1") and split[1].content.count("...") == 2
    sliced = chunking.chunk_sections([section(1, "y" * 250)], most=100, least=0)
    assert "".join(re.sub("^# h1\n*", "", c.content) for c in sliced) == "y" * 250
    merged = chunking.chunk_sections([section(1, "small"), section(2, "z" * 300), section(3, "end")], least=50)
    assert len(merged) == 1 and merged[0].header == "h1" and merged[0].line_end == 4
    assert chunking.chunk_sections([]) == []
    with pytest.raises(ValueError):
        chunking.chunk_sections([section(1, "a")], most=0)


def twin_markdown(s):
    lines = [x.rstrip(" \t\f\v") for x in s.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    kept, blank = [], 0
    for x in lines:
        blank = 0 if x else blank + 1
        if blank <= 2:
            kept.append(x)
    out = []
    for i, x in enumerate(kept):
        out.append(x)
        if x.startswith("#") and i + 1 < len(kept) and kept[i + 1]:
            out.append("")
    return "\n".join(out)


def test_markdown_twin(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["# h", "a", "\n", "\n", "\r\n", " ", "\t", "##x", "b c"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.markdown(F.col("t"))).collect()]
    assert got == [twin_markdown(t) for t in texts]


def test_hashed_vectors(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha größe"), (2, ""), (3, "beta alpha größe alpha")], "doc_id int, text string")
    out = defaultdict(dict)
    for r in retrieval.hashed_vectors(docs, "doc_id", "text").collect():
        out[r.doc_id][r.slot] = r.value
    v = [0.0] * 384
    for term, tf in (("alpha", 2), ("beta", 1), ("größe", 1)):
        h = zlib.crc32(term.encode("ascii", "ignore"))
        v[h % 384] += tf if h >> 31 else -tf
    norm = math.sqrt(sum(x * x for x in v))
    assert out[1] == pytest.approx({i: x / norm for i, x in enumerate(v) if x}) and out[1] == out[3] and 2 not in out


def test_code_tokens_example(spark):
    row = spark.createDataFrame([("def getUserById(user_id): HTTP v2Foo the",)], "t string").select(T.code_tokens(F.col("t"))).first()[0]
    assert set(row) == {"def", "getuserbyid", "get", "user", "by", "id", "user_id", "http", "v2foo", "v", "foo"}


def test_jaccard_keeps_five(spark):
    names = spark.createDataFrame([(i, "x") for i in range(8)], "node_id int, name string")
    out = edges.jaccard_edges(names).collect()
    assert Counter(r.source for r in out)[0] == 5 and all(r.source < r.target and r.score == 1.0 for r in out)


def test_store_round_trip(spark, tmp_path):
    rows = [("a", "b", "call", 0.5, 1, {"k": "v"}, 7), ("b", "c", "reference", 1.0, 1, {}, 8)]
    e = spark.createDataFrame(rows, "source string, target string, type string, score double, created_at bigint, metadata map<string,string>, ord bigint")
    store.write_edges(e, str(tmp_path))
    back = store.read_edges(spark, str(tmp_path)).filter("type = 'call'")
    assert [r.target for r in back.collect()] == ["b"] and "PartitionFilters: [isnotnull(type" in back._jdf.queryExecution().toString()
    e.write.json(str(tmp_path / "json"))
    assert store.edges_from_json(spark, str(tmp_path / "json")).count() == 2
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception, match="FAILFAST|malformed|Malformed|MALFORMED"):
        store.edges_from_json(spark, str(tmp_path / "bad.json")).collect()
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id int, text string")
    store.write_index(spark, docs, "doc_id", "text", str(tmp_path / "i"), 2)
    posts, stats = store.read_index(spark, str(tmp_path / "i"))
    assert posts.count() == 3 and stats.count() == 2


def test_files_and_logs_from_disk(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n\ndef runTask(x):\n    return x\n")
    (tmp_path / "src" / "l.md").write_bytes("# Größe".encode("latin-1"))
    (tmp_path / "chat.aichat").write_text('{"id": "k", "messages": [{"content": "hi"}]}')
    found = {r.path.rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert found["l.md"].content == "# Größe" and found["a.py"].bytes == 40
    turns = conversations.conversations(files.read_texts(spark, str(tmp_path), "*.aichat")).collect()
    assert [(t.conv_id, t.role, t.text) for t in turns] == [("k", "user", "hi")]


def test_index_build(spark):
    rows = [("src/a.py", 60, "def loadTable(x):\n    return parseFile(x)\n" + "# note\n" * 3), ("src/b.py", 60, "loadTable = 1\nparseFile = 2\n"), ("env/skip.py", 60, "x"), ("docs/r.md", 60, "# Title\ntext of the ParserGuide\n")]
    nodes = index.build_nodes(spark.createDataFrame(rows, "path string, bytes long, content string"))
    got = nodes.collect()
    assert {r.path for r in got} == {"src/a.py", "src/b.py", "docs/r.md"} and all(re.fullmatch("[0-9a-f]{40}", r.hash) for r in got)
    assert index.build_edges(nodes).count() >= 1


def test_streamed_windows_equal_batch(spark, sf_dir):
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(mentions.replayed(spark, sf_dir)) == key(mentions.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "1 hour"))


def test_plans_stay_narrow(spark, sf_dir):
    """Column pruning and filter pushdown reach the scan; postings of a query are joined on terms; no cartesian product."""
    from graphquarry.queries import QUERIES

    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan("timeline")
    for name in ("reference_edges", "jaccard_edges", "claims_resolve", "triple_revise", "file_diff", "bm25_topk"):
        assert "Cartesian" not in plan(name) and "NestedLoop" not in plan(name)


def test_jaccard_edges_with_hot_names(spark):
    rng = random.Random(9)
    sets = {f"n{i:03d}": {f"w{min(39, int(rng.expovariate(0.15)))}" for _ in range(rng.randint(1, 14))} | ({"hot"} if i % 3 else set()) for i in range(120)}
    rows = [(k, w) for k, v in sets.items() for w in v]
    want = {}
    for a in sorted(sets):
        scored = sorted((-len(sets[a] & sets[b]) / len(sets[a] | sets[b]), b) for b in sets if b > a)
        want |= {(a, b): (-s, r + 1) for r, (s, b) in enumerate(scored[:5]) if -s > 0.2}
    names = spark.createDataFrame(rows, "node_id string, name string")
    got = {(r.source, r.target): (r.score, r["rank"]) for r in edges.jaccard_edges(names).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)
    some = spark.createDataFrame([("n003",), ("n100",)], "node_id string")
    assert {(r.source, r.target) for r in edges.jaccard_edges(names, sources=some).collect()} == {k for k in want if k[0] in ("n003", "n100")}


def rows_of_joins(ran):
    """Rows that each join of a collected DataFrame's plan made."""
    todo, made = [ran._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in kind:
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return made


def test_jaccard_edges_make_no_row_for_one_common_name_that_is_too_few(spark):
    rows = [(i, w) for i in range(60) for w in ("x", f"a{i}", f"b{i}", f"c{i}" if i > 1 else "b0")]
    out = edges.jaccard_edges(spark.createDataFrame(rows, "node_id int, name string"))
    assert [(r.source, r.target, r["rank"]) for r in out.collect()] == [(0, 1, 1)]
    made = rows_of_joins(out)
    assert made and max(made) < 60  # 1,770 pairs share x


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 0.9])
@pytest.mark.parametrize("short", [0, 4, 12])
def test_jaccard_edges_by_all_lookups(spark, threshold, short):
    rng = random.Random(4)
    sets = {i: {f"w{min(19, int(rng.expovariate(0.2)))}" for _ in range(rng.randint(1, 20))} for i in range(50)}
    got = edges.jaccard_edges(spark.createDataFrame([(k, w) for k, v in sets.items() for w in v], "node_id int, name string"), threshold, 100, short=short)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r.source, r.target): pytest.approx(r.score) for r in got.collect()} == {k: v for k, v in want.items() if v > threshold}


def test_token_overlap_looks_equal_queries_up_once(spark):
    queries = spark.createDataFrame([(i, "load table" if i % 2 else "table load x_y") for i in range(200)] + [(200, ""), (201, None)], "query_id long, text string")
    tags = spark.createDataFrame([("load it",), ("table load",), ("none",)], "tag string")
    out = retrieval.token_overlap(queries, tags, 1)
    got = {tuple(r) for r in out.select("query_id", "tag", "score", "rank").collect()}
    assert {r for r in got if r[0] % 2} == {(i, "table load", 1.0, 1) for i in range(1, 200, 2)} and {r[0] for r in got} == set(range(200))
    out.collect()
    made = rows_of_joins(out)  # tokens with tags, then queries with what their tokens found
    assert sorted(made)[0] <= 6 and max(made) == 200


@pytest.mark.parametrize("part", [1, 7, 50_000])
def test_lifted_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(edges, "LIFTED_ROWS", part)
    docs = [(f"d{i:02d}", f"src/{'ab'[i % 2]}/{('readme.md', 'overview.md')[i % 3 > 0]}") for i in range(30)]
    asked = [(q, f"r{q}", f"src/{'ab'[q % 2]}/x/m.py") for q in range(6)] + [(0, "d00", "src/a/readme.md"), (3, "d00", "src/b/x/m.py")]
    out = edges.lifted(spark.createDataFrame(asked, "query_id long, node_id string, path string"), spark.createDataFrame(docs, "node_id string, path string"))
    want = set()
    for q in range(6):
        gone = {n for k, n, _ in asked if k == q}
        found = sorted((0 if "readme" in p else 2, p, n) for n, p in docs if p.startswith(f"src/{'ab'[q % 2]}/") and n not in gone)
        want |= {(q, n, p, r) for r, (_, p, n) in enumerate(found[:5], 1)}
    assert {tuple(r) for r in out.collect()} == want


def test_packed_sends_few_blocks_of_equal_size(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(q, f"n{i:03d}", f"f{rng.randrange(3)}", rng.choice([0.1, 0.5, 0.9]), rng.choice([0, 3, 20, 40, 90, 300]) if i % 40 else 2, "code") for q in range(3) for i in range(300)]
    want = {(q, i) for q in range(3) for i in context.greedy_pack([(r[1], r[2], r[3], r[4]) for r in rows if r[0] == q], 250)}
    out = context.packed(spark.createDataFrame(rows, "query_id long, node_id string, path string, importance double, tokens int, role string"), 250)
    assert {(r.query_id, r.node_id) for r in out.collect()} == want
    assert "row_number" in out._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_by_rarest_key(spark):
    paths = [f"src/{w}{i}.py" for i, w in enumerate(("auth", "Author", "ab", "x_auth", "deep/ab"))]
    nodes = spark.createDataFrame([(f"n{i}", p, f"def f{i}(): call(ab.c) or auth_{i}") for i, p in enumerate(paths)], "node_id string, path string, content string")
    refs = spark.createDataFrame([(1, r) for r in ("auth", "ab", "b", "c", "AUTH", "nothing", "f2", "call(", "auth_3")], "conv_id long, ref string")
    want = set()
    for r in ("auth", "ab", "b", "c", "AUTH", "nothing", "f2", "call(", "auth_3"):
        for i, p in enumerate(paths):
            content = f"def f{i}(): call(ab.c) or auth_{i}"
            if r.lower() in p.lower():
                want.add((r, f"n{i}", "path"))
            elif re.search(rf"(?<!\w){re.escape(r)}(?!\w)", content):
                want.add((r, f"n{i}", "content"))
    assert {(r.ref, r.target, r.rule) for r in edges.conversation_links(refs, nodes).collect()} == want
    docs = spark.createDataFrame([(1, "one two three four"), (2, "xone two threex"), (3, "abcdefghijklmnopqrstuvwxyz")], "doc_id long, text string")
    quotes = spark.createDataFrame([("one two three",), ("defghijk",), ("two four",)], "quote string")
    assert {tuple(r) for r in edges.quoted_in(quotes, docs).collect()} == {("one two three", 2), ("defghijk", 1)}


def test_citations_at_one_place_have_an_order(spark):
    rows = [(1, 5, s, "p", o) for s, o in (("b", "c"), ("c", "a"), ("a", "b"))] + [(1, 9, "a", "p", "z")]
    triples = spark.createDataFrame([("a", "p", "b")], "s string, p string, o string")
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        got = graph.citation_gaps(spark.createDataFrame(order, "answer long, pos long, s string, p string, o string"), triples).collect()
        assert {(r.pos, r.s, r.in_graph, r.adjacent) for r in got} == {(5, "a", True, True), (5, "b", False, True), (5, "c", False, True), (9, "a", False, None)}


def test_blocks_are_not_shuffled(spark):
    mentions = spark.range(500).selectExpr("id AS mention_id", "concat(char(97 + id % 3), id) AS surface")
    entities = spark.range(300).selectExpr("concat('e', id) AS entity_id", "concat(char(65 + id % 3), id) AS name")
    found = claims.blocks(mentions.repartition(3), entities)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {tuple(r) for r in found.collect()} == {(i, f"e{j}") for i in range(500) for j in range(300) if i % 3 == j % 3}


def test_blocks_deal_mentions_to_tasks(spark):
    """Mentions of one small file are not paired in the one task that reads it."""
    mentions = spark.range(0, 1000, 1, 1).selectExpr("id AS mention_id", "CASE WHEN id = 7 THEN NULL WHEN id = 8 THEN '' ELSE concat(char(97 + id % 3), id) END AS surface")
    entities = spark.createDataFrame([("e1", "A"), (None, "ax"), ("e2", "b"), ("e2", "b"), ("e3", None), ("e4", "")], "entity_id string, name string")
    found = claims.blocks(mentions, entities, 100)
    assert found.rdd.getNumPartitions() == 10
    letter = {i: "abc"[i % 3] for i in range(1000) if i not in (7, 8)} | {8: ""}
    held = {"a": ["e1", None], "b": ["e2", "e2"], "": ["e4"]}
    assert Counter(map(tuple, found.collect())) == Counter((i, e) for i, k in letter.items() for e in held.get(k, []))


def test_lookups_broadcast_no_index(spark, sf_dir):
    """Exploded keys of the texts are never the side that goes to the driver, however small their file is."""
    texts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS id", "concat('src/', p_name, p_partkey, '.py') AS path")
    needles = texts.filter("id % 50 = 0").select(F.col("path").alias("needle"), edges.longest_grams(F.col("path")).alias("keys"))
    for small in (0, 200_000):
        found = edges.by_rarest(needles, texts.select("id", edges.all_grams(F.col("path")).alias("keys")), small)
        text = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("rightHint=(strategy=broadcast)" in text) == (small > 0) and "leftHint=(strategy=merge)" in text
        # a long needle meets its own text and hardly another, where any three characters of a number are in many
        assert needles.count() <= found.count() < 2 * needles.count()


def test_capped_subgraphs_keep_the_best_seeds(spark):
    from graphquarry.plans import query as Q

    e = spark.createDataFrame([("z", "a"), ("z", "b"), ("y", "c")], "source string, target string").selectExpr("source", "target", "'call' AS type", "1.0D AS score", "0L AS ord")
    seeds = spark.createDataFrame([(1, "y", 0.2), (1, "z", 0.9)], "query_id long, doc_id string, score double")
    nodes = lambda **kw: {r.node for r in Q.subgraphs(seeds, e, 2, cap=3, **kw).collect()}
    assert nodes() == {"a", "b", "c"} and nodes(by_score=True) == {"z", "y", "a"}
