"""Centrality of query subgraphs, and greedy packing into a token budget.

Subgraphs hold at most schema.NODE_CAP nodes a query (graph expansion caps them), so one query's subgraph is one group of
bounded size; queries are spread over tasks.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema


def _neighbours(pairs: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in pairs:
        out[a][b] = out[b][a] = w
    return out


def _parts(graph: dict[str, dict[str, float]]) -> list[list[str]]:
    seen: set[str] = set()
    parts = []
    for start in sorted(graph):
        if start in seen:
            continue
        seen.add(start)
        part, queue = [start], deque([start])
        while queue:
            for x in graph[queue.popleft()]:
                if x not in seen:
                    seen.add(x)
                    part.append(x)
                    queue.append(x)
        parts.append(sorted(part))
    return parts


def shortest(graph: dict[str, dict[str, float]], source: str) -> tuple[dict[str, float], dict[str, list[str]], dict[str, float], list[str]]:
    """Distances, predecessors on shortest paths, numbers of shortest paths, and nodes by distance."""
    dist, before, count, order = {source: 0.0}, {source: []}, {source: 1.0}, []
    heap, done = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for w, step in graph[v].items():
            far = d + step
            if w not in dist or far < dist[w] - 1e-12:
                dist[w], before[w], count[w] = far, [v], count[v]
                heapq.heappush(heap, (far, w))
            elif abs(far - dist[w]) <= 1e-12 and w not in done:
                before[w].append(v)
                count[w] += count[v]
    return dist, before, count, order


def leading(a: np.ndarray) -> np.ndarray:
    """The leading eigenvector, of length 1, of a symmetric matrix without negative entries: what equal entries tend to when multiplied
    by it plus one again and again.  At any size by a solver, so no number of steps decides; zeros if an entry is no number."""
    n = len(a)
    if not np.isfinite(a).all():
        return np.zeros(n)
    values, vectors = np.linalg.eigh(a)
    top = vectors[:, values >= values[-1] - 1e-12 * n * abs(values[-1])]
    x = np.abs(top @ top.sum(axis=0))
    return x / (np.linalg.norm(x) or 1.0)


def centralities(pairs: list[tuple[str, str, float]]) -> pd.DataFrame:
    """Betweenness, closeness (weights as distances), degree and eigenvector (weights as affinities) of each node, all
    within its component, and their weighted sum.  Exact at any size."""
    graph = _neighbours(pairs)
    rows = []
    for part in _parts(graph):
        n = len(part)
        between = dict.fromkeys(part, 0.0)
        close = {}
        for s in part:
            dist, before, count, order = shortest(graph, s)
            total = sum(dist.values())
            close[s] = (len(dist) - 1) / total if total > 0 else 0.0
            owed = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    owed[v] += count[v] / count[w] * (1 + owed[w])
                if w != s:
                    between[w] += owed[w]
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
        at = {v: i for i, v in enumerate(part)}
        a = np.zeros((n, n))
        for v in part:
            for w, weight in graph[v].items():
                a[at[v], at[w]] = weight
        eigen = leading(a)
        for v in part:
            rows.append((v, between[v] * scale, len(graph[v]) / (n - 1) if n > 1 else 1.0, close[v], float(eigen[at[v]])))
    out = pd.DataFrame(rows, columns=["node", "betweenness", "degree", "closeness", "eigenvector"])
    out["composite"] = sum(w * out[c] for c, w in schema.CENTRALITY_WEIGHTS.items())
    return out


def centrality(pairs: DataFrame) -> DataFrame:
    """(query_id, node, betweenness, degree, closeness, eigenvector, composite) of (query_id, a, b, weight)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = centralities(list(zip(pdf["a"], pdf["b"], pdf["weight"], strict=True)))
        out.insert(0, "query_id", pdf["query_id"].iloc[0])
        return out

    return pairs.groupBy("query_id").applyInPandas(solve, "query_id bigint, node string, betweenness double, degree double, closeness double, eigenvector double, composite double")


def path_qualities(seeds: list[str], edges: list[tuple[str, str, str]], depth: int = 6) -> dict[str, float]:
    """Quality of the first path, breadth first, from the seeds to each node: 1 for a seed, else by the share of reference
    edges and the length.  Reference edges are walked forward only, other live ones both ways."""
    follow: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    for s, t, kind in edges:
        if kind in schema.UNTRAVERSED_TYPES:
            continue
        follow[s].append((t, kind == "reference"))
        if kind != "reference":
            follow[t].append((s, False))
    seen: dict[str, tuple[int, int]] = {}
    queue = deque((s, 0, 0) for s in seeds)
    best: dict[str, float] = {}
    while queue:
        v, d, refs = queue.popleft()
        quality = 1.0 if d == 0 else 0.2 + 0.5 * refs / d + 0.3 * max(0.0, 1 - d / 10)
        best[v] = max(best.get(v, 0.0), quality)
        if v in seen or d > depth:
            continue
        seen[v] = (d, refs)
        for w, is_ref in follow[v]:
            if w not in seen:
                queue.append((w, d + 1, refs + is_ref))
    return best


def greedy_pack(blocks: list[tuple[str, str, float, int]], budget: int) -> list[str]:
    """Ids of the blocks (id, path, importance, tokens) that are taken, in order.

    By falling importance: the best block of each path with the other blocks of that path that fit; a stub under 25
    tokens waits if its path has a block over ten times as long.  What is left fills up with any block that fits.
    """
    ranked = sorted(blocks, key=lambda b: (-b[2], b[0]))
    of: dict[str, list] = defaultdict(list)
    for b in ranked:
        of[b[1]].append(b)
    longest = {path: max(x[3] for x in own) for path, own in of.items()}
    taken: dict[str, None] = {}
    used: set[str] = set()
    room = budget

    def take(b) -> None:
        nonlocal room
        if b[0] not in taken and b[3] <= room:
            taken[b[0]] = None
            room -= b[3]

    for b in ranked:
        stub = b[3] < 25 and longest[b[1]] > 10 * b[3]
        if b[1] in used or b[3] > room or stub:
            continue
        used.add(b[1])
        for x in [b, *of[b[1]]]:
            take(x)
    for b in ranked:
        take(b)
    return list(taken)


def packed(blocks: DataFrame, budget: int = schema.PACK_TOKENS) -> DataFrame:
    """(query_id, node_id, slot) of (query_id, node_id, path, importance, tokens, role): taken blocks, roles in order.

    Of blocks of one query, path and number of tokens one is only taken after all that rank before it, so those that would not fit into the
    budget together are left where they are (one of each stays, since a path's longest block decides about stubs).
    """
    from pyspark.sql import Window as W

    if not blocks.filter("tokens < 0").limit(1).count():
        place = F.row_number().over(W.partitionBy("query_id", "path", "tokens").orderBy(F.desc("importance"), "node_id"))
        fit = F.col("tokens").isNull() | (F.col("tokens") == 0) | (F.col("place") <= F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("tokens"))))
        blocks = blocks.withColumn("place", place).filter(fit).drop("place")
    role_order = {"code": 0, "readme": 1, "config": 2, "text": 3}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        roles = dict(zip(pdf["node_id"], pdf["role"], strict=True))
        ids = greedy_pack(list(zip(pdf["node_id"], pdf["path"], pdf["importance"], pdf["tokens"], strict=True)), budget)
        ids.sort(key=lambda i: role_order.get(roles[i], 4))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "node_id": ids, "slot": np.arange(len(ids), dtype=np.int32)})

    return blocks.groupBy("query_id").applyInPandas(solve, "query_id bigint, node_id string, slot int")


def prefix_packed(blocks: DataFrame, budget: int) -> DataFrame:
    """(query_id, node_id, upto): the longest start of the ranking whose tokens fit the budget; a window, no Python."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.desc("importance"), "node_id").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("upto", F.sum("tokens").over(order)).filter(F.col("upto") <= budget).select("query_id", "node_id", "upto")


def qualities(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, quality) of seeds (query_id, node) and edges (query_id, source, target, type)."""

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        order = right.sort_values(["source", "target", "type"])
        best = path_qualities(sorted(left["node"]), list(zip(order["source"], order["target"], order["type"], strict=True)))
        return pd.DataFrame({"query_id": key[0], "node": list(best), "quality": list(best.values())})

    return seeds.groupBy("query_id").cogroup(edges.groupBy("query_id")).applyInPandas(solve, "query_id bigint, node string, quality double")
