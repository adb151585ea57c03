"""Exact nearest vectors of many queries, tile by tile: a task holds the best k of each query so far, never the pairs.

Vectors and queries are packed into rows of a fixed number, each a matrix; queries are broadcast in parts of a checked size and Spark
pairs them with the tiles.  A product of matrices tells which rows can be among the best, and only those are scored in the
order of `retrieval.dot`, so that scores are those of `retrieval.dense_scores` to the last bit.  The work is queries by vectors; what a task holds
is one tile, one block and the best k of its queries, and what is shuffled is k rows a query and task.

A vector that is null or holds a null scores null, one of length zero or with a component that is not finite NaN; by the order of
scores NaN comes first and null last, as in SQL.  Vectors of different lengths fail.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import broadcast_blocks, spread

#: Rows of a tile of vectors and of a block of queries.
TILE, BLOCK = 4096, 1024
#: Blocks in one broadcast; with 64 components a block takes half a MB.
BLOCKS = 64
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 19
#: More than rounding and the order of sums can move a score.
SLACK = 2e-6

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this module

PACKED = "n int, ids binary, units binary"


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component on."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def places(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded half up as Spark rounds the shortest decimal of a double."""
    scaled = np.abs(scores) * 1e6
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(abs(float(scores[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, scores) + 0.0


class Best:
    """The best k of a block's queries so far, by rounded score and then id."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int) -> None:
        self.ids, self.units, self.k = ids, units, k
        self.floor = np.full(len(ids), -np.inf)
        self.query, self.doc, self.score, self.place = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)

    def add(self, docs: np.ndarray, units: np.ndarray) -> None:
        near = self.units @ units.T
        floor = self.floor
        if near.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k])
        query, doc = np.nonzero(near >= (floor - SLACK)[:, None])
        for at in range(0, len(query), PAIRS):
            q, d = query[at : at + PAIRS], doc[at : at + PAIRS]
            score = _folded(self.units[q], units[d])
            self._merge(q, docs[d], score)

    def _merge(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        query, doc, score, place = (np.concatenate(x) for x in ((self.query, query), (self.doc, doc), (self.score, score), (self.place, places(score))))
        order = np.lexsort((doc, -place, query))
        query, doc, score, place = query[order], doc[order], score[order], place[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.k
        last = np.flatnonzero(np.arange(len(query)) - first == self.k - 1)
        self.query, self.doc, self.score, self.place = query[kept], doc[kept], score[kept], place[kept]
        self.floor[query[last]] = place[last] / 1e6


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """PACKED rows of (id, embedding), of at most `size` vectors each, scaled to length one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                if len(set(sizes.tolist())) > 1:
                    raise ValueError("vectors must have one length")
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
                x = x / np.sqrt(_folded(x, x))[:, None]
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "units": pa.array([x.tobytes()], pa.binary())})

    return rows.mapInArrow(run, PACKED)


def best(queries: DataFrame, vectors: DataFrame, k: int, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score): of each query (query_id bigint, embedding) at least the k best vectors (doc_id bigint, embedding) by exact cosine,
    ties by rounded score to the least id, for retrieval.top_k to rank."""
    x = F.col("embedding")
    number = F.transform(x, lambda c: c.cast("double"))
    none = x.isNull() | F.exists(x, lambda c: c.isNull())
    odd = F.exists(number, lambda c: F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists(number, lambda c: c != 0)
    kind = F.when(none, "none").when(odd, "odd").otherwise("plain")
    q, v = queries.select("query_id", x, kind.alias("kind")), spread(vectors).select("doc_id", x, kind.alias("kind"))
    kinds = {r.kind: r["count"] for r in q.groupBy("kind").count().collect()}
    blocks = _packed(q.filter("kind = 'plain'").select("query_id", x).repartition(max(1, -(-kinds.get("plain", 0) // block))), block)
    tiles = _packed(v.filter("kind = 'plain'").select("doc_id", x), tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["q"] not in held:
                    held[r["q"]] = Best(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_units"]).reshape(r["q_n"], -1), k)
                units = np.frombuffer(r["units"]).reshape(r["n"], -1)
                if units.shape[1] != held[r["q"]].units.shape[1]:
                    raise ValueError("vectors must have one length")
                held[r["q"]].add(np.frombuffer(r["ids"], np.int64), units)
        for b in held.values():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(b.ids[b.query]), "doc_id": pa.array(b.doc), "score": pa.array(b.score)})

    parts = broadcast_blocks(blocks.select(F.monotonically_increasing_id().alias("q"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("units").alias("q_units")), BLOCKS)
    scored = reduce(DataFrame.unionByName, [tiles.join(p, F.lit(True)).mapInArrow(run, "query_id bigint, doc_id bigint, score double") for p in parts])
    if set(kinds) <= {"plain"} and not vectors.filter(kind != "plain").limit(1).count():
        return scored
    # pairs without a number: the first ids are enough, since they all tie
    first = lambda of: F.broadcast(v.filter(of).select("doc_id").orderBy("doc_id").limit(k))
    pairs = lambda asked, of, score: q.filter(asked).select("query_id").join(first(of), F.lit(True)).select("query_id", "doc_id", F.lit(score).cast("double").alias("score"))
    nan = float("nan")
    rest = [pairs("kind = 'plain'", "kind = 'odd'", nan), pairs("kind = 'odd'", "kind <> 'none'", nan), pairs("kind <> 'none'", "kind = 'none'", None), pairs("kind = 'none'", "true", None)]
    return reduce(DataFrame.unionByName, rest, scored)
