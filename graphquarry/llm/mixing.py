"""Mixing sources to target weights: a token budget handed down a tree of domains, languages and sources.

A leaf holds the tokens of its documents, up to max_epochs times.  The budget is handed down level by level: a node
shares its budget among its children by weight, no child gets more than its subtree holds, and what a short child
leaves goes to its siblings by weight; a subtree that is short as a whole has left its rest to the level above
already.  A leaf with a budget of e whole passes and a rest takes every document e times and, in epoch e, the longest
start of the seeded order (md5 of seed, epoch and id) whose tokens fit the rest.

The start's end is found from sums over short prefixes of that order, then inside one prefix, so no leaf is ever
sorted whole.  Only the table of leaves is broadcast, if it has at most max_leaves rows.

Null languages and sources are the label 'unknown'; null and empty texts have 0 tokens and take part in any start that
reaches them.  Rows that repeat an id stand together in the order, and enter or stay out together.  Ties of the
order go by id.  A label without a weight has weight 1; a weight of 0 gets nothing.  An empty table gives an empty table.  Columns of the input keep their names and values; mix_domain
or mix_epoch, where one of them has that name, get the name with _1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_within, cut, free

LANG_WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
SHARE, EPOCHS, SEED = 0.6, 3, "mix-1"
_TREE = ("mix_domain", "mix_lang", "mix_source")


def _digits(rows: int) -> int:
    """Hexadecimal digits of the prefixes: 3, or more where the largest leaf would have over 4,096 rows a prefix."""
    return max(3, math.ceil(math.log(max(1, rows) / 4096, 16))) if rows > 4096 else 3


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def domain_of(source: Column) -> Column:
    """Four domains by the first digit of the source's md5."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 1), 16, 10).cast("int") % 4).cast("string"))


def _weight(label: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[label], F.lit(1.0))


def _fill(children: DataFrame, parent: tuple[str, ...], name: str) -> DataFrame:
    """children (parent.., name, cap, weight, budget of the parent) with what each gets, as `given`.

    In the order of cap / weight the children that are full come first; the level of the others is what is left
    by the weight that is left.
    """
    group = [F.col(c) for c in parent] or [F.lit(0)]
    df = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    order = W.partitionBy(*group).orderBy("ratio", name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumn("level", F.when(left > 0, (F.col("budget") - before) / left).otherwise(F.lit(0.0)))
    open_ = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(W.partitionBy(*group))
    df = df.withColumn("open", open_)
    given = F.when(F.col("weight") <= 0, 0.0).when(F.col("ratio") <= F.col("level"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.greatest(F.lit(0.0), F.col("open"))))
    return df.withColumn("given", given).drop("ratio", "level", "open", "budget")


def budgets(leaves: DataFrame, share: float, epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """leaves (tree.., avail) with passes (whole epochs) and rest (tokens of the epoch after them)."""
    total = leaves.agg(F.sum("avail")).first()[0] or 0
    low = leaves.withColumn("cap", F.col("avail") * float(epochs)).withColumn("weight", _weight(F.col(_TREE[2]), weights[2]))
    mid = low.groupBy(*_TREE[:2]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(_TREE[1]), weights[1]))
    top = mid.groupBy(_TREE[0]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(_TREE[0]), weights[0]))
    top = _fill(top.withColumn("budget", F.lit(float(int(share * total)))), (), _TREE[0])
    mid = _fill(mid.join(top.select(_TREE[0], F.col("given").alias("budget")), _TREE[0]), _TREE[:1], _TREE[1])
    low = _fill(low.join(mid.select(*_TREE[:2], F.col("given").alias("budget")), list(_TREE[:2])), _TREE[:2], _TREE[2])
    budget = F.floor(F.round("given", 3)).cast("long")
    passes = F.when(F.col("avail") > 0, F.floor(budget / F.greatest("avail", F.lit(1)))).otherwise(0).cast("int")
    return low.select(*_TREE, "avail", budget.alias("leaf_budget"), passes.alias("passes")).withColumn("rest", F.col("leaf_budget") - F.col("passes") * F.col("avail"))


def _place(seed: str, epoch: Column, key: Column) -> Column:
    return F.concat(F.md5(F.concat(F.lit(seed), F.lit(":"), epoch.cast("string"), F.lit(":"), key)), F.lit(":"), F.lpad(key, 20, "0"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang: Column | None = None,
    source: Column | None = None,
    domain: Column | None = None,
    share: float = SHARE,
    epochs: int = EPOCHS,
    weights: tuple[dict, dict, dict] = ({}, LANG_WEIGHTS, {}),
    seed: str = SEED,
    max_leaves: int = 100_000,
) -> DataFrame:
    """docs, each row as often as it is taken, with mix_domain and mix_epoch."""
    source = F.coalesce((F.col("source") if source is None else source).cast("string"), F.lit("unknown"))
    lang = F.coalesce((F.col("lang") if lang is None else lang).cast("string"), F.lit("unknown"))
    domain = domain_of(source) if domain is None else F.coalesce(domain.cast("string"), F.lit("unknown"))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    tree = [domain.alias(_TREE[0]), lang.alias(_TREE[1]), source.alias(_TREE[2])]
    narrow = cut(docs.select(*tree, key.alias("mix_key"), tokens(F.col(text_col)).alias("mix_tokens")))
    sizes = cut(narrow.groupBy(*_TREE).agg(F.sum("mix_tokens").alias("avail"), F.count(F.lit(1)).alias("rows")))
    digits = _digits(sizes.agg(F.max("rows")).first()[0] or 0)
    leaves = cut(budgets(sizes.drop("rows"), share, epochs, weights))
    leaf = list(_TREE)
    placed = narrow.join(broadcast_within(leaves, max_leaves), leaf).withColumn("mix_place", _place(seed, F.col("passes"), F.col("mix_key")))
    placed = placed.withColumn("mix_prefix", F.substring("mix_place", 1, digits))
    sums = placed.groupBy(*leaf, "rest", "mix_prefix").agg(F.sum("mix_tokens").alias("t"))
    sums = sums.withColumn("upto", F.sum("t").over(W.partitionBy(*leaf).orderBy("mix_prefix").rowsBetween(W.unboundedPreceding, 0)))
    ends = cut(sums.filter("upto > rest and upto - t <= rest").select(*leaf, F.col("mix_prefix").alias("end_prefix"), (F.col("upto") - F.col("t")).alias("end_before")))
    last = placed.join(broadcast_within(ends, max_leaves), leaf).filter("mix_prefix = end_prefix").groupBy(*leaf, "rest", "end_prefix", "end_before", "mix_place").agg(F.sum("mix_tokens").alias("t"))
    last = last.withColumn("upto", F.col("end_before") + F.sum("t").over(W.partitionBy(*leaf).orderBy("mix_place").rowsBetween(W.unboundedPreceding, 0)))
    last = last.groupBy(*leaf).agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("mix_place"))), F.max("end_prefix")).alias("end"))
    chosen = cut(leaves.select(*leaf, "passes").join(last, leaf, "left").select(*[F.col(c).alias(f"{c}_of") for c in leaf], F.col("passes").alias("mix_passes"), F.coalesce("end", F.lit("z")).alias("mix_end")))
    wide = docs.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(docs.columns)], *tree, key.alias("mix_key"))
    taken = wide.join(broadcast_within(chosen, max_leaves), [F.col(c) == F.col(f"{c}_of") for c in leaf])
    times = F.col("mix_passes") + (_place(seed, F.col("mix_passes"), F.col("mix_key")) <= F.col("mix_end")).cast("int")
    taken = taken.withColumn("mix_times", times).filter("mix_times > 0")
    own = [F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return taken.select(*own, F.col(_TREE[0]).alias(free("mix_domain", docs.columns)), F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1)).alias(free("mix_epoch", docs.columns)))


def oracle_sql() -> str:
    """The same budgets and starts as DuckDB SQL, with one window over each whole leaf."""
    fill = lambda new, old, parent, name: f"""
{new}r AS (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE CAST('inf' AS DOUBLE) END AS ratio FROM {old}),
{new}l AS (SELECT *, CASE WHEN sum(weight) OVER b > 0 THEN (budget - coalesce(sum(cap) OVER a, 0)) / sum(weight) OVER b ELSE 0 END AS level FROM {new}r
  WINDOW a AS (PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY {parent} ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{new}o AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER (PARTITION BY {parent}) AS opn FROM {new}l),
{new} AS (SELECT *, CASE WHEN weight <= 0 THEN 0 WHEN ratio <= level THEN cap ELSE least(cap, weight * greatest(0, opn)) END AS given FROM {new}o)"""  # noqa: E731
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items())
    word = "[^\\x20\\t\\n\\x0B\\f\\r]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'unknown') AS la, coalesce(source, 'unknown') AS so, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, lang, source,
  len(regexp_extract_all(coalesce(text, ''), '{word}')) AS tok FROM documents),
e AS (SELECT *, 'd' || CAST((instr('0123456789abcdef', substr(md5(so), 1, 1)) - 1) % 4 AS VARCHAR) AS dom FROM d),
lf AS (SELECT dom, la, so, CAST(sum(tok) AS BIGINT) AS avail, CAST(sum(tok) AS DOUBLE) * {EPOCHS} AS cap, CAST(1 AS DOUBLE) AS weight FROM e GROUP BY ALL),
m0 AS (SELECT dom, la, sum(cap) AS cap, CAST(CASE la {weights} ELSE 1 END AS DOUBLE) AS weight FROM lf GROUP BY dom, la),
t0 AS (SELECT dom, sum(cap) AS cap, CAST(1 AS DOUBLE) AS weight, (SELECT floor({SHARE} * CAST(sum(avail) AS DOUBLE)) FROM lf) AS budget FROM m0 GROUP BY dom),
{fill("t1", "t0", "1", "dom")},
m1 AS (SELECT m0.*, t1.given AS budget FROM m0 JOIN t1 USING (dom)),
{fill("m2", "m1", "dom", "la")},
l1 AS (SELECT lf.*, m2.given AS budget FROM lf JOIN m2 USING (dom, la)),
{fill("l2", "l1", "dom, la", "so")},
b AS (SELECT dom, la, so, avail, CAST(floor(round(given, 3)) AS BIGINT) AS lb FROM l2),
p AS (SELECT *, CASE WHEN avail > 0 THEN CAST(lb // avail AS INT) ELSE 0 END AS passes FROM b),
q AS (SELECT *, lb - passes * avail AS rest FROM p),
s AS (SELECT e.*, passes, rest, md5('{SEED}:' || passes || ':' || k) || ':' || lpad(k, 20, '0') AS pl FROM e JOIN q USING (dom, la, so)),
c AS (SELECT *, sum(tok) OVER (PARTITION BY dom, la, so ORDER BY pl) AS upto FROM s),
x AS (SELECT *, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM c)
SELECT doc_id, dom AS mix_domain, lang, source, CAST(unnest(range(times)) AS INT) AS mix_epoch FROM x WHERE times > 0"""
