"""Packing: length buckets that waste the least padding, and token-budget batches inside each bucket.

The histogram of all lengths, on a grid whose size is bounded whatever the lengths (exact up to 255, then 128
cells an octave), goes to the driver, each cell with its longest length; dynamic programming over it finds the bucket
bounds with the least padding.  A bound is a length that occurs; buckets are cut between cells only.
Every document is padded to its bucket's bound, so a batch of a bucket holds budget // bound documents (one, where a
document is longer than the budget).  Inside a bucket documents stand in a seeded order and are cut into
batches by their rank, which is found from counts over prefixes of that order and a rank inside each prefix: no
bucket is ever ranked in one task.  A row without an id stands by a hash of its text.

Null and empty texts have length 0 and share the first bucket; its bound is at least 1.  Ties of the order go by id, and
among rows that repeat an id arbitrarily.  Fewer distinct lengths than buckets give as many buckets as lengths.  An
empty table gives an empty table.  The columns `keep` keep their names and values; a result whose name one of them (or the
id) has gets the name with _1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free
from .mixing import tokens

BUCKETS, BUDGET, SEED = 12, 16_384, "pack-1"


def cell_of(n: int) -> int:
    step = 1 << max(0, n.bit_length() - 8)
    return -(-n // step) * step


def cell(n: Column) -> Column:
    """cell_of as a column: lengths rounded up to 8 leading bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.length(F.bin(n)) - 8)).cast("long")
    return (F.ceil(n / step) * step).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """The bucket bounds, among the cells' lengths, with the least total padding; ties: the lower bound."""
    m = len(lengths)
    if m == 0:
        return []
    n, s = np.concatenate([[0.0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(sums)])
    cost = np.full(m + 1, np.inf)
    cost[0] = 0.0
    back = []
    for _ in range(min(buckets, m)):
        after, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            total = cost[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            at[j] = int(np.argmin(total))
            after[j] = total[at[j]]
        back.append(at)
        cost = after
    bounds, j = [], m
    for at in reversed(back):
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, `keep`, n_tokens, bucket, bound, batch (within the bucket) and slot (within the batch), a row a document."""
    names = dict.fromkeys((id_col, *keep))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.xxhash64(F.col(text_col)).cast("string")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(names)], tokens(F.col(text_col)).alias("n"), F.concat(F.md5(F.concat(F.lit(f"{seed}:"), key)), F.lit(":"), F.lpad(key, 20, "0")).alias("place"))
    histogram = sorted(tuple(r) for r in rows.groupBy(cell(F.col("n")).alias("c")).agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).collect())  # bounded by the grid
    bounds = best_bounds(*(np.array([float(r[i]) for r in histogram]) for i in (1, 2, 3)), buckets)
    total = sum(r[2] for r in histogram)
    digits = max(2, math.ceil(math.log(max(1, total) / 65536, 16))) if total > 65536 else 2
    number, bound = F.lit(0), F.lit(1)
    for i, b in reversed(list(enumerate(bounds))):
        fits = F.col("n") <= b
        number = F.lit(i) if i == len(bounds) - 1 else F.when(fits, i).otherwise(number)
        bound = F.lit(max(1, b)) if i == len(bounds) - 1 else F.when(fits, max(1, b)).otherwise(bound)
    rows = rows.select("*", number.cast("int").alias("bucket"), bound.cast("long").alias("bound"), F.substring("place", 1, digits).alias("prefix"))
    counts = rows.groupBy("bucket", "prefix").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("bucket").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("bucket", "prefix", before.alias("before"))
    rank = F.row_number().over(W.partitionBy("bucket", "prefix").orderBy("place")) - 1 + F.col("before")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bound")))
    ranked = rows.join(counts, ["bucket", "prefix"]).withColumn("rank", rank)
    return ranked.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)],
        F.col("n").alias(free("n_tokens", names)),
        F.col("bucket").alias(free("bucket", names)),
        F.col("bound").alias(free("bound", names)),
        F.floor(F.col("rank") / size).cast("long").alias(free("batch", names)),
        (F.col("rank") % size).cast("long").alias(free("slot", names)),
    )


def oracle_sql() -> str:
    """The same buckets and batches as DuckDB SQL: a table for each number of buckets, and one window over each whole bucket."""
    word = "[^\\x20\\t\\n\\x0B\\f\\r]+"
    step = "CAST(pow(2, greatest(0, length(bin(n)) - 8)) AS BIGINT)"
    levels = ",\n".join(
        f"b{i} AS MATERIALIZED (SELECT h.j, h.ck, h.cs, min({{'c': p.m.c + h.mx * (h.ck - p.ck) - (h.cs - p.cs), 'i': p.j, 'l': list_append(p.m.l, h.mx)}}) AS m FROM b{i - 1} p JOIN h ON h.j > p.j GROUP BY h.j, h.ck, h.cs)"
        for i in range(1, BUCKETS + 1)
    )
    every = " UNION ALL ".join(f"SELECT {i} AS b, j, m.l AS l FROM b{i}" for i in range(1, BUCKETS + 1))
    return f"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n, md5('{SEED}:' || doc_id) || ':' || lpad(CAST(doc_id AS VARCHAR), 20, '0') AS place FROM documents),
g AS (SELECT (n + {step} - 1) // {step} * {step} AS c, max(n) AS mx, count(*) AS k, sum(n) AS s FROM d GROUP BY 1),
h AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY c) AS BIGINT) AS j, mx, CAST(sum(k) OVER (ORDER BY c) AS BIGINT) AS ck, CAST(sum(s) OVER (ORDER BY c) AS BIGINT) AS cs FROM g),
b0 AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS ck, CAST(0 AS BIGINT) AS cs, {{'c': CAST(0 AS BIGINT), 'i': CAST(0 AS BIGINT), 'l': CAST([] AS BIGINT[])}} AS m),
{levels},
l AS (SELECT l FROM ({every}) WHERE j = (SELECT max(j) FROM h) AND b = (SELECT least({BUCKETS}, max(j)) FROM h)),
u AS (SELECT unnest(l) AS top, generate_subscripts(l, 1) - 1 AS bucket FROM l),
w AS (SELECT d.*, (SELECT min(bucket) FROM u WHERE top >= d.n) AS bucket FROM d),
x AS (SELECT w.*, greatest(1, u.top) AS bound, row_number() OVER (PARTITION BY w.bucket ORDER BY place) - 1 AS r FROM w JOIN u USING (bucket))
SELECT doc_id, n AS n_tokens, CAST(bucket AS INT) AS bucket, CAST(bound AS BIGINT) AS bound, CAST(r // greatest(1, {BUDGET} // bound) AS BIGINT) AS batch, CAST(r % greatest(1, {BUDGET} // bound) AS BIGINT) AS slot FROM x"""
