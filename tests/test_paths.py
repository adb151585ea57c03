"""Weighted shortest paths of many subgraphs at once against a queue-based search of each."""

import heapq
import random

import pytest

from graphquarry.operators import betweenness, paths


def graph_of(rng, n, m, weights):
    pairs = {}
    while len(pairs) < m:
        a, b = sorted(rng.sample(range(n), 2))
        pairs[f"n{a:03d}", f"n{b:03d}"] = rng.choice(weights)
    return pairs


def search(pairs, source):
    near = {}
    for (a, b), w in pairs.items():
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for w, step in near.get(v, []):
            if d + step < best.get(w, 1e18) - 1e-12:
                best[w] = d + step
                heapq.heappush(heap, (d + step, w))
    return best


@pytest.mark.parametrize("width", [0.5, 2.0, 100.0])
def test_distances(spark, width):
    rng = random.Random(7)
    graphs = {q: graph_of(rng, 40, 60, [0.5, 1.0, 1.5, 2.25]) for q in range(3)}
    pairs = spark.createDataFrame([(q, a, b, w) for q, g in graphs.items() for (a, b), w in g.items()], "query_id long, a string, b string, weight double")
    seeds = [(q, s) for q, g in graphs.items() for s in sorted({x for p in g for x in p})[:3]] + [(9, "alone")]
    got = {(r.query_id, r.seed, r.node): r.distance for r in paths.distances(spark.createDataFrame(seeds, "query_id long, node string"), pairs, width=width).collect()}
    want = {(q, s, v): d for q, s in seeds for v, d in search(graphs.get(q, {}), s).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_routes_prefer_high_scores(spark):
    rows = [(1, "a", "b", 1.0, 1.0, "semantic"), (1, "b", "c", 1.0, 1.0, "reference"), (1, "a", "c", 5.0, 5.0, "semantic")]
    pairs = spark.createDataFrame(rows, "query_id long, a string, b string, weight double, score double, label string")
    titles = spark.createDataFrame([(x, x.upper()) for x in "abc"], "node string, title string")
    seeds = spark.createDataFrame([(1, "a"), (1, "not here")], "query_id long, node string")
    found = paths.best_routes(seeds, pairs, titles, 2).orderBy("rank").collect()
    assert [(r.path, r.score, r.narrative) for r in found] == [(["a", "b", "c"], 2.0, "A → B [semantic] → C [reference]"), (["a", "b"], 1.0, "A → B [semantic]")]
    assert paths.best_routes(seeds.limit(0), pairs, titles).count() == 0


def between(pairs, n, sources=None):
    """Brandes by breadth."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = dict.fromkeys(near, 0.0)
    for s in sources or near:
        dist, count, order, before = {s: 0}, {s: 1}, [s], {s: []}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w], before[w] = dist[v] + 1, 0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                owed[v] += count[v] / count[w] * (1 + owed[w])
            if w != s:
                out[w] += owed[w]
    return {v: x * (n / len(sources) if sources else 1) / ((n - 1) * (n - 2)) for v, x in out.items()}


def test_betweenness_at_all_pivots_is_exact(spark):
    rng = random.Random(11)
    pairs = list(graph_of(rng, 60, 110, [1.0]))
    df = spark.createDataFrame([(a, b) for a, b in pairs] + [(b, a) for a, b in pairs[:10]] + [(pairs[0][0], pairs[0][0])], "source string, target string")
    n = len({x for p in pairs for x in p})
    want = between(pairs, n)
    got = {r.node: r.betweenness for r in betweenness.betweenness(df, pivots=n).collect()}
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)


def test_betweenness_of_sampled_pivots(spark):
    rng = random.Random(12)
    pairs = list(graph_of(rng, 150, 400, [1.0]))
    df = spark.createDataFrame(pairs, "source string, target string")
    n = len({x for p in pairs for x in p})
    want = between(pairs, n)
    few = betweenness.pivots_for(n)
    rows = betweenness.betweenness(df, pivots=few, seed=3).collect()
    worst = max(abs(r.betweenness - want[r.node]) for r in rows)
    assert few < n and {r.pivots for r in rows} == {few} and worst <= betweenness.error_bound(n, few)
    top = lambda v: set(sorted(v, key=v.get, reverse=True)[:10])
    assert len(top({r.node: r.betweenness for r in rows}) & top(want)) >= 6
    again = {r.node: r.betweenness for r in betweenness.betweenness(df, pivots=few, seed=3).collect()}
    assert all(again[r.node] == pytest.approx(r.betweenness) for r in rows)


def test_betweenness_of_twins(spark):
    """Many nodes with the same neighbours: exact values, and rounds that hold classes instead of nodes."""
    pairs = [(f"s{i}", f"n{i % 3}") for i in range(60)] + [(f"s{i}", f"h{i % 2}") for i in range(60)] + [("n0", "r"), ("n1", "r"), ("n2", "r"), ("t", "r"), ("u", "v"), ("u", "w")]
    df = spark.createDataFrame(pairs, "source string, target string")
    names = sorted({x for p in pairs for x in p})
    some = [x for x in names if x.endswith(("0", "5"))]
    assert betweenness._twins(betweenness.cut(df.union(df.selectExpr("target", "source")).toDF("src", "dst").distinct())).select("class").distinct().count() == 6 + 3 + 2 + 2 + 2
    for chosen, sources in ((spark.createDataFrame([(x,) for x in some], "node string"), some), (len(names), None)):
        want = between(pairs, len(names), sources)
        got = {r.node: r.betweenness for r in betweenness.betweenness(df, pivots=chosen).collect()}
        assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v]) for v in want)
