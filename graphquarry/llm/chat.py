"""Chat formatting: collapse logged snapshots of growing conversations, then render what remains.

The turns of a conversation are numbered in the order of (turn, role, text), nulls first, among them turns that are no numbers; a turn
logged twice counts once.
The hash of its first k turns is a running sum of hashes of (number, role, text); a conversation whose whole hash is
the hash of a shorter start of another one is dropped by an anti-join, and of equal conversations the least id stays.

All turns are put in the order of (conversation, turn, role, text) by ranges of equal size, so that a conversation with a large share
of all turns, and turns without a conversation or a number, are spread over ranges.  Numbers and sums inside a range are
mended by small tables of (conversation, range).  Only hashes go through these steps; texts are moved to be put in
order and to be rendered, a long conversation in parts.

Null roles and texts count as empty; rows with a null conv_id are one conversation.  An empty table gives an empty table.
Other columns of the input are not returned, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_within, cut

#: Turns to a rendered part.
PART = 200
_SUMS = ("s1", "s2", "s3", "s4")


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, role, text, at, range): the distinct turns; `at` follows the order, without gaps in a range."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).try_cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = ("conv", "turn", "role", "text")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return rows.select("conv", "role", "text", "at", F.shiftright("at", 33).alias("range"))


def spread(rows: DataFrame, totals: dict[str, Column], max_rows: int = 200_000) -> DataFrame:
    """rows with, for each named total of a conversation's range, the sum over its earlier ranges and over all of it."""
    ranges = rows.groupBy("conv", "range").agg(*[c.alias(k) for k, c in totals.items()])
    before = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = cut(
        ranges.select(
            F.col("conv").alias("r_conv"),
            F.col("range").alias("r_range"),
            *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in totals],
            *[F.sum(k).over(W.partitionBy("conv")).alias(f"{k}_all") for k in totals],
        )
    )
    return rows.join(broadcast_within(sums, max_rows), rows.conv.eqNullSafe(F.col("r_conv")) & (rows.range == F.col("r_range"))).drop("r_conv", "r_range")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, range, at, place, n) of ordered() with the running hash sums s1..s4 of the turns up to each."""
    slim = turns.select("conv", "range", "at", F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(71), "text", "role").alias("y"))
    inside = W.partitionBy("conv", "range").orderBy("at")
    slim = spread(slim.withColumn("local", F.row_number().over(inside).cast("long")), {"k": F.count(F.lit(1))})
    slim = slim.select("conv", "range", "at", (F.col("k_before") + F.col("local")).alias("place"), F.col("k_all").alias("n"), "x", "y")
    one, two = F.xxhash64("place", "x", "y"), F.xxhash64(F.lit(71), "y", "x", "place")
    low, high = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)), lambda h: F.shiftrightunsigned(h, 32)
    rows = slim.select("conv", "range", "at", "place", "n", *[f(h).alias(s) for s, (f, h) in zip(_SUMS, ((low, one), (high, one), (low, two), (high, two)), strict=True)])
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    running = spread(rows, {s: F.sum(s) for s in _SUMS})
    return running.select("conv", "range", "at", "place", "n", *[(F.sum(s).over(so_far) + F.col(f"{s}_before")).alias(s) for s in _SUMS])


def collapse(rows: DataFrame) -> DataFrame:
    """(conv) of the conversations of numbered() that no other one continues, each once."""
    key = ("place", *_SUMS)
    whole = rows.filter("place = n").groupBy(*key).agg(F.min("conv").alias("conv"))
    starts = rows.filter("place < n").select(*key).distinct()
    return whole.join(starts, list(key), "left_anti").select("conv")


def render(turns: DataFrame, rows: DataFrame, kept: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """(conv_id, part, n_turns, rendered): kept conversations in ChatML, PART turns to a row."""
    kept = kept.select(F.col("conv").alias("k_conv"))
    offsets = rows.groupBy("conv", "range").agg(F.min(F.col("place") - F.col("at")).alias("offset"), F.max("n").alias("n"))
    offsets = cut(offsets.join(kept, offsets.conv.eqNullSafe(kept.k_conv), "left_semi").select(F.col("conv").alias("r_conv"), F.col("range").alias("r_range"), "offset", "n"))
    rows = turns.join(broadcast_within(offsets, max_rows), turns.conv.eqNullSafe(F.col("r_conv")) & (turns.range == F.col("r_range")))
    rows = rows.withColumn("place", F.col("at") + F.col("offset")).withColumn("part", F.floor((F.col("place") - 1) / PART).cast("int"))
    said = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("s"))))
    return rows.groupBy("conv", "part").agg(F.max("n").alias("n_turns"), said.alias("t")).select(F.col("conv").alias("conv_id"), "part", "n_turns", F.array_join(F.transform("t", lambda x: x["s"]), "").alias("rendered"))


def chat_format(turns: DataFrame, **columns: str) -> DataFrame:
    turns = cut(ordered(turns, **columns))
    rows = cut(numbered(turns))
    return render(turns, rows, collapse(rows))


ORACLE = """
WITH r AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations),
c AS (SELECT conv_id, list(role || chr(31) || txt ORDER BY turn NULLS FIRST, role, txt) AS l,
  list('<|im_start|>' || role || chr(10) || txt || '<|im_end|>' || chr(10) ORDER BY turn NULLS FIRST, role, txt) AS s FROM r GROUP BY conv_id),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE len(b.l) > len(c.l) AND b.l[1:len(c.l)] = c.l)
  AND NOT EXISTS (SELECT 1 FROM c b WHERE b.l = c.l AND b.conv_id < c.conv_id)),
p AS (SELECT *, unnest(range((len(s) + 199) // 200)) AS part FROM m)
SELECT conv_id, CAST(part AS INT) AS part, CAST(len(s) AS BIGINT) AS n_turns, array_to_string(s[part * 200 + 1:part * 200 + 200], '') AS rendered FROM p"""
