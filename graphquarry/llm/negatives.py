"""Hard negatives by distributed radix selection of integer scores.

Components become floor(256 * x); a row's score is its integer inner product with an anchor.  Anchors go in blocks of a fixed
number, each broadcast, against all rows; no pairs are ever made as rows.  For a block, the k-th best score of a target (an anchor
with a range of scores) is found digit by digit: each task counts the scores of its rows in 256 equal buckets of the target's
range, Spark adds the counts up, and the bucket that holds the k-th becomes the range of the next digit, until it holds few rows
or one score.  Only then the rows at or above it are gathered, from each task the best k at most, and ranked.  A task sends the
counts of the highest buckets alone, as far as they hold k rows, since the k-th of all rows can't be lower.

1. Targets are the anchors over the whole range of scores, k = 5, rows of the same label: the positives.
2. Targets are the (anchor, positive) pairs over their window of scores, k = 10, rows of other labels: the negatives.

What the driver holds is the state of one block's targets.  Ties go by the least id at every step.

Rows with a null id, label or vector, or with a null or non-finite component take no part.  Rows that repeat an id are one row, that of
the least label and then the least vector.  A vector shorter than another is taken to go on with zeros.  An empty table, no anchor, an
anchor without a positive or a window without rows give no rows.  Components over 2^55 count as 2^55 and scores
stay within 64 bits, the nearest one where a product is beyond.  Other columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import spread
from .common import cut

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
SCALE, BUCKETS = 256, 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Anchors of a block; with 64 components its vectors take 2 MB, the counts of its windows 42 MB a task.
BLOCK_ANCHORS = 4096
#: A bucket with this many rows or fewer is not divided further.
FEW = 64
_MOST = 1 << 55
_INT = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, relabel: bool) -> DataFrame:
    """(id, label, v) of the rows that take part, an id once."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    label = F.col(label_col).cast("long")
    if relabel:
        label = F.when(F.col(id_col) % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    most = F.lit(_MOST).cast("double")
    whole = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c.cast("double") * SCALE, -most), most)), F.lit(-_MOST)), F.lit(_MOST)))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~bad)
    one = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(label.alias("label"), whole.alias("v")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return one.select("id", "row.label", "row.v")


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """(n, width) integers of a list column, rows that are shorter filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    sizes, values = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    if (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def inner_products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact integer products (rows, anchors), held within 64 bits."""
    most = [int(max(x.max(initial=0), -int(x.min(initial=0)))) for x in (rows, anchors)]
    bound = rows.shape[1] * most[0] * most[1]
    if bound < 1 << 53:  # every partial sum is a whole number that a double holds
        return (rows.astype(np.float64) @ anchors.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return rows @ anchors.T
    return np.clip(rows.astype(object) @ anchors.astype(object).T, -_INT.max, _INT.max).astype(np.int64)


class Targets:
    """What one block asks for: for each target its anchor's place in the block and the range of scores, both ends included."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> None:
        self.ids, self.labels, self.vectors, self.same = ids, labels, vectors, same
        self.anchor, self.low, self.high = anchor, low, high

    def plain(self) -> tuple:
        """What to broadcast: workers need not have this module."""
        return self.ids, self.labels, self.vectors, self.anchor, self.low, self.high, self.same

    def within(self, low: np.ndarray, high: np.ndarray, which: np.ndarray) -> Targets:
        return Targets(self.ids, self.labels, self.vectors, self.anchor[which], low[which], high[which], self.same)

    def hits(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the row in the batch, target, score) of the scores in range."""
        if not batch.num_rows or not len(self.anchor):
            return
        v = matrix(batch.column("v"), self.width(batch.column("v")))
        anchors = np.zeros((len(self.vectors), v.shape[1]), np.int64)
        anchors[:, : self.vectors.shape[1]] = self.vectors
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        step = max(1, (1 << 21) // max(len(self.anchor), len(anchors)))
        for at in range(0, len(v), step):
            part = slice(at, at + step)
            fits = labels[part, None] == self.labels[None, :]
            fits = fits & (ids[part, None] != self.ids[None, :]) if self.same else ~fits
            scores = inner_products(v[part], anchors)[:, self.anchor]
            row, target = np.nonzero(fits[:, self.anchor] & (scores >= self.low) & (scores <= self.high))
            yield row + at, target, scores[row, target]

    def width(self, lists: pa.Array) -> int:
        sizes = np.diff(lists.offsets.to_numpy())
        return max(int(sizes.max(initial=0)), self.vectors.shape[1])


def bucket_width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Scores in a bucket of the range, so that BUCKETS of them cover it; ranges may be wider than 63 bits."""
    return ((high.astype(np.uint64) - low.astype(np.uint64)) >> np.uint64(8)) + np.uint64(1)


def counted(rows: DataFrame, targets: Broadcast, k: int) -> DataFrame:
    """(target, bucket, n): scores in each bucket, counted from the top of the target's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Targets(*targets.value)
        high, size = t.high.astype(np.uint64), bucket_width(t.low, t.high)
        counts = np.zeros(len(t.anchor) * BUCKETS, np.int64)
        for batch in batches:
            for _, target, score in t.hits(batch):
                bucket = ((high[target] - score.astype(np.uint64)) // size[target]).astype(np.int64)
                counts += np.bincount(target * BUCKETS + bucket, minlength=len(counts))
        counts = counts.reshape(-1, BUCKETS)
        target, bucket = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < k))
        yield pa.RecordBatch.from_pydict({"target": pa.array(target.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(counts[target, bucket])})

    return rows.mapInArrow(run, "target int, bucket int, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def best_of_each(target: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each target, by score and then the least id."""
    order = np.lexsort((ids, ~score, target))
    t = target[order]
    starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    place = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
    return order[place < k]


def gathered(rows: DataFrame, targets: Broadcast, k: int) -> DataFrame:
    """(target, rank, id, score): the k best rows of each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Targets(*targets.value)
        held = [np.zeros(0, np.int64)] * 3
        pending: list[tuple] = []

        def settle() -> list[np.ndarray]:
            joined = [np.concatenate(x) for x in zip(held, *pending, strict=True)]
            at = best_of_each(*joined, k)
            return [x[at] for x in joined]

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for row, target, score in t.hits(batch):
                pending.append((target, score, ids[row]))
                if sum(len(x[0]) for x in pending) > 1 << 20:
                    held, pending = settle(), []
        target, score, ids = settle() if pending else held
        yield pa.RecordBatch.from_pydict({"target": pa.array(target.astype(np.int32)), "id": pa.array(ids), "score": pa.array(score)})

    best = Window.partitionBy("target").orderBy(F.desc("score"), "id")
    return rows.mapInArrow(run, "target int, id long, score long").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def selected(rows: DataFrame, targets: Targets, k: int) -> DataFrame:
    """(target, rank, id, score): the k best rows of each target; the range of each is narrowed digit by digit before."""
    sc = rows.sparkSession.sparkContext
    low, high = targets.low.copy(), targets.high.copy()
    floor, need = targets.low.copy(), np.full(len(low), k, np.int64)
    undecided = np.arange(len(low))
    while len(undecided):
        counts = counted(rows, sc.broadcast(targets.within(low, high, undecided).plain()), k)
        upto = F.sum("n").over(Window.partitionBy("target").orderBy("bucket"))
        # never more rows than a target's buckets that hold its k best
        counts = counts.withColumn("upto", upto).filter(F.col("upto") - F.col("n") < k).toPandas().sort_values(["target", "bucket"])
        keep = counts["upto"] - counts["n"] < need[undecided[counts["target"]]]
        last = counts[keep].groupby("target").tail(1)
        t = undecided[last["target"].to_numpy()]
        size = bucket_width(low[t], high[t])
        top = high[t].astype(np.uint64) - last["bucket"].to_numpy().astype(np.uint64) * size
        bottom = np.where(top - low[t].astype(np.uint64) < size, low[t], (top - size + np.uint64(1)).astype(np.int64))
        whole = last["upto"].to_numpy() < need[t]  # fewer rows than asked for: all are taken
        high[t], low[t] = top.astype(np.int64), bottom
        floor[t] = np.where(whole, targets.low[t], bottom)
        need[t] -= (last["upto"] - last["n"]).to_numpy()
        undecided = t[~whole & (size > 1) & (last["n"].to_numpy() > FEW)]
    return gathered(rows, sc.broadcast(targets.within(floor, targets.high, np.arange(len(floor))).plain()), k)


def windows(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the highest score of a negative: LEAST_SHARE * score <= 100 * negative <= MOST_SHARE * score."""
    whole, rest = np.divmod(score, 100)
    return LEAST_SHARE * whole - (-LEAST_SHARE * rest) // 100, MOST_SHARE * whole + MOST_SHARE * rest // 100


def block_negatives(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, reach: np.ndarray, positives: int, negatives: int) -> DataFrame:
    first = selected(rows, Targets(ids, labels, vectors, np.arange(len(ids)), -reach, reach, same=True), positives).toPandas()
    anchor, score = first["target"].to_numpy().astype(np.int64), first["score"].to_numpy().astype(np.int64)
    low, high = windows(score)
    some = low <= high
    first, anchor, low, high = first[some], anchor[some], low[some], high[some]
    found = selected(rows, Targets(ids, labels, vectors, anchor, low, high, same=False), negatives)
    pairs = pa.table({"target": np.arange(len(anchor), dtype=np.int32), "anchor_id": ids[anchor], "positive_id": first["id"].to_numpy().astype(np.int64), "positive_score": score[some]})
    pairs = rows.sparkSession.createDataFrame(pairs)  # a block's: at most positives * BLOCK_ANCHORS rows
    return found.join(F.broadcast(pairs), "target").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", anchors: Column | None = None, relabel: bool = True,
    positives: int = POSITIVES, negatives: int = NEGATIVES, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors is a condition on the column id."""
    rows = cut(spread(quantised(vectors, id_col, vec_col, label_col, relabel)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c))
    asked = cut(rows.filter(F.col("id") % ANCHOR_EVERY == 0 if anchors is None else anchors).withColumn("norm", norm))
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    n = asked.count()
    many = -(-n // block_anchors)
    out: list[DataFrame] = []
    for i in range(many):
        # about block_anchors rows of the table of anchors at a time
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(many)) == i).orderBy("id").toArrow()
        if not block.num_rows:
            continue
        v = block.column("v").combine_chunks()
        v = matrix(v, int(np.diff(v.offsets.to_numpy()).max(initial=0)))
        # no score is beyond the product of the lengths
        reach = block.column("norm").to_numpy() * longest * (1 + 1e-9) + 1
        reach = np.where(reach < 2.0**62, np.minimum(reach, 2.0**62).astype(np.int64), _INT.max)
        out.append(cut(block_negatives(rows, block.column("id").to_numpy(), block.column("label").to_numpy(), v, reach, positives, negatives)))
        if len(out) == 32:  # plans stay short
            out = [cut(reduce(DataFrame.union, out))]
    if not out:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.union, out)


#: The same in SQL.  The inner products are sums over pairs of anchor and row.
ORACLE = """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
