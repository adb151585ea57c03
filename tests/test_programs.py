"""Dependences of methods with equal bodies, which are made once, against plain Python."""

import itertools

import pytest

from graphquarry.operators import programs

FLOW = {
    "f": [("in", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "out")],
    "g": [("in", "x"), ("x", "out"), ("in", "out")],
    "h": [("in", "out")],
    "e": [("in", "x"), ("x", "out"), ("in", None), (None, "out")],
}


def dominated(edges, entry="in"):
    """(node, dominator) by removal."""

    def reached(without=None):
        seen, todo = set(), [entry] * (entry != without)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [d for s, d in edges if s == n and d != without]
        return seen

    every = reached()
    return {(n, c) for n in every for c in every if n == c or n not in reached(c)}


def copies(flow, n):
    return [(f"{m}{i}", s, d) for m, i in itertools.product(flow, range(n)) for s, d in flow[m]]


def test_equal_graphs_are_solved_once(spark, monkeypatch):
    flow = {m: e for m, e in FLOW.items() if m != "e"}
    solved = []
    inner = programs._dominators
    monkeypatch.setattr(programs, "_dominators", lambda cfg, *a, **k: solved.append(cfg.select("method").distinct().count()) or inner(cfg, *a, **k))
    cfg = spark.createDataFrame(copies(flow, 40) + [("g0", "in", "x")], "method string, src string, dst string")
    got = [(r.method, r.node, r.dominator) for r in programs.dominators(cfg, "in").collect()]
    want = {(f"{m}{i}", *p) for m in flow for i in range(40) for p in dominated(flow[m])}
    assert len(got) == len(want) and set(got) == want
    assert solved == [4]  # f, g, h and g0 with an edge twice


def test_rows_that_differ_by_nulls_are_not_equal(spark):
    rows = [("m", "a", None), ("n", None, "a"), (None, "a", None), ("o", "ab", "c"), ("p", "a", "bc")]
    df = spark.createDataFrame(rows, "method string, src string, dst string")
    seen = []
    out = programs.once_each([df], lambda t: seen.append(t.count()) or t).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, rows)) and seen == [4]


@pytest.mark.parametrize("small", [0, 200_000])
def test_dependences_of_copies(spark, small):
    facts = [("in", "v", "def"), ("a", "v", "use"), ("b", "v", "def"), ("d", "v", "use"), ("x", "v", "def"), ("out", "v", "use")]
    one = spark.createDataFrame(copies(FLOW, 1), "method string, src string, dst string")
    many = spark.createDataFrame(copies(FLOW, 9), "method string, src string, dst string")
    of = lambda n: spark.createDataFrame([(f"{m}{i}", *f) for m, i in itertools.product(FLOW, range(n)) for f in facts], "method string, node string, var string, kind string")
    want = {(r.method[0], r.src, r.dst, r["var"]) for r in programs._reaching_definitions(one, of(1)).collect()}
    got = [(r.method, r.src, r.dst, r["var"]) for r in programs.reaching_definitions(many, of(9), small).collect()]
    assert want and len(got) == 9 * len(want) and set(got) == {(f"{w[0]}{i}", *w[1:]) for w in want for i in range(9)}
