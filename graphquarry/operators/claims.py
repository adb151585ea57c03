"""Claims: temporal resolution, grounding, revision, entity resolution."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.materialise import broadcast_blocks, cut, spread

#: Mentions of a task that pairs them with candidates, about.
TASK_MENTIONS = 20_000


def date_key(s: Column) -> Column:
    """Sort key of an ISO date: '' if missing or unparseable, so it sorts first and supersedes nothing."""
    return F.coalesce(F.when(F.try_to_timestamp(s).isNotNull(), s), F.lit(""))


def with_previous(rows: DataFrame, keys: list[str], bucket: str, order: list[str], of: list[str]) -> DataFrame:
    """rows with `before`: the columns `of` of the previous row of the same keys, null for the first.

    Keys may be hot: rows are ordered inside (keys, bucket) only, and the last row of each bucket is handed to the next one
    of the key; `bucket` must not fall along `order`.
    """
    here = F.struct(*[F.col(c).alias(c) for c in of])
    inside = W.partitionBy(*keys, bucket).orderBy(*order)
    lasts = rows.groupBy(*keys, bucket).agg(F.max_by(here, F.struct(*order)).alias("last"))
    handed = lasts.select(*keys, bucket, F.lag("last").over(W.partitionBy(*keys).orderBy(bucket)).alias("handed"))
    return rows.join(handed, [*keys, bucket]).withColumn("before", F.coalesce(F.lag(here).over(inside), F.col("handed"))).drop("handed")


def _keyed(claims: DataFrame) -> DataFrame:
    """Claims with their key; a null entity or attribute counts as empty."""
    part = lambda c: F.coalesce(F.lower(c), F.lit(""))
    return claims.select("claim_id", "value", F.coalesce("valid_at", F.lit("")).alias("valid_at"), part("entity").alias("e"), part("attribute").alias("a"), date_key(F.col("valid_at")).alias("at"))


def temporal_edges(claims: DataFrame) -> DataFrame:
    """(source, target, type): each claim supersedes the one before it of its key if both are dated and it is later,
    and contradicts it if the values differ.  Order: date, then claim_id."""
    pairs = with_previous(_keyed(claims), ["e", "a"], "at", ["at", "claim_id"], ["claim_id", "value", "at"])
    later = pairs.filter((F.col("before.at") != "") & (F.col("before.at") < F.col("at")))
    kinds = F.when(F.col("value") != F.col("before.value"), F.array(F.lit("supersedes"), F.lit("contradicts"))).otherwise(F.array(F.lit("supersedes")))
    return later.select(F.col("claim_id").alias("source"), F.col("before.claim_id").alias("target"), F.explode(kinds).alias("type"))


def latest(claims: DataFrame, as_of: str | None = None) -> DataFrame:
    """The last claim of each key, of those dated at or before as_of (a comparison of strings); ties: the last claim_id."""
    own = claims if as_of is None else claims.filter((F.col("valid_at") != "") & (F.col("valid_at") <= as_of))
    return own.groupBy(F.lower("entity").alias("entity"), F.lower("attribute").alias("attribute")).agg(F.max_by(F.struct("claim_id", "value", "valid_at"), F.struct(date_key(F.col("valid_at")), "claim_id")).alias("c")).select("entity", "attribute", "c.*")


def stream_edges(claims: DataFrame) -> DataFrame:
    """(source, target, type) in the order of arrival (claim_id), from the earlier claim to the new one."""
    rows = _keyed(claims).withColumn("bucket", F.floor(F.col("claim_id") / 100_000))
    new = with_previous(rows, ["e", "a"], "bucket", ["claim_id"], ["claim_id", "value", "valid_at"]).filter(F.col("value") != F.col("before.value"))
    later = (F.col("before.valid_at") != "") & (F.col("valid_at") != "") & (F.col("before.valid_at") < F.col("valid_at"))
    kinds = F.when(later, F.array(F.lit("CONTRADICTS"), F.lit("SUPERSEDES"))).otherwise(F.array(F.lit("CONTRADICTS")))
    return new.select(F.col("before.claim_id").alias("source"), F.col("claim_id").alias("target"), F.explode(kinds).alias("type"))


def _normal(df: DataFrame) -> DataFrame:
    return df.withColumns({c: T.normal_triple_part(F.col(c)) for c in ("s", "p", "o")})


def evaluate(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """claims (id, s, p, o) with supported: whether the normalised triple exists.  A null part is never supported."""
    known = _normal(triples).select("s", "p", "o").distinct().withColumn("k", F.lit(True))
    return _normal(claims).join(known, ["s", "p", "o"], "left").select("id", F.coalesce("k", F.lit(False)).alias("supported"))


def revise(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """(id, s, p, o, part): unsupported claims mended by the first anchor triple that differs in predicate or object only;
    abandoned if another anchor differs in the same part with another value."""
    known = cut(_normal(triples).select("s", "p", "o").distinct())  # read three times below
    own = cut(_normal(claims).join(known, ["s", "p", "o"], "left_anti"))
    by_object = own.join(known.withColumnRenamed("p", "new"), ["s", "o"]).select("id", "s", F.col("new").alias("p"), "o", F.lit("predicate").alias("part"), F.col("new").alias("value"))
    by_predicate = own.join(known.withColumnRenamed("o", "new"), ["s", "p"]).select("id", "s", "p", F.col("new").alias("o"), F.lit("object").alias("part"), F.col("new").alias("value"))
    anchors = by_object.unionByName(by_predicate)
    first = anchors.groupBy("id").agg(F.min(F.struct("s", "p", "o", "part")).alias("a"), F.count_distinct(F.when(F.col("part") == "predicate", F.col("value"))).alias("np"), F.count_distinct(F.when(F.col("part") == "object", F.col("value"))).alias("no"))
    alone = F.when(F.col("a.part") == "predicate", F.col("np")).otherwise(F.col("no")) == 1
    return first.filter(alone).select("id", "a.s", "a.p", "a.o", "a.part")


def resolve(mentions: DataFrame, aliases: DataFrame, contexts: DataFrame) -> DataFrame:
    """(mention_id, id, confidence): unknown 0.5, unique 0.6, one candidate sharing a context token 0.9, else null 0.1.

    mentions: (mention_id, surface, token), a row a context token.
    """
    known = aliases.select("alias", "entity_id").distinct()
    counts = known.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("only"))
    one = mentions.select("mention_id", "surface").distinct().join(counts, F.col("surface") == F.col("alias"), "left")
    open_ = one.filter("n > 1").select("mention_id", "surface")
    hits = open_.join(mentions, ["mention_id", "surface"]).join(known, F.col("surface") == F.col("alias")).join(contexts.distinct(), ["entity_id", "token"]).select("mention_id", "entity_id").distinct()
    hits = hits.groupBy("mention_id").agg(F.count(F.lit(1)).alias("m"), F.min("entity_id").alias("by_context"))
    both = one.join(hits, "mention_id", "left")
    id_ = F.when(F.col("n").isNull(), F.col("surface")).when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("by_context"))
    sure = F.when(F.col("n").isNull(), 0.5).when(F.col("n") == 1, 0.6).when(F.col("m") == 1, 0.9).otherwise(0.1)
    return both.select("mention_id", id_.alias("id"), sure.alias("confidence"))


def add_relations(relations: DataFrame, resolved: DataFrame) -> DataFrame:
    """relations (s_mention, p, o_mention) with resolved ends and ok."""
    a, b = (resolved.select(F.col("mention_id").alias(f"{k}_mention"), F.col("id").alias(k)) for k in ("s", "o"))
    return relations.join(a, "s_mention", "left").join(b, "o_mention", "left").select("s_mention", "p", "o_mention", "s", "o", (F.col("s").isNotNull() & F.col("o").isNotNull()).alias("ok"))


def provenance(relations: DataFrame) -> DataFrame:
    """(s, p, o, n, sources): how often a triple was given, and by which sources in order."""
    return relations.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


def answer_entities(answers: DataFrame, names: DataFrame, grounded: DataFrame) -> DataFrame:
    """(answer_id, name, verdict): names that an answer has, grounded if they are an end of a grounded edge, else absent.

    A substring has no equi-join: the names go to the answers in parts of a checked size.
    """
    ends = grounded.select(F.lower("s").alias("k")).union(grounded.select(F.lower("o"))).distinct().withColumn("g", F.lit(True))
    has = F.contains(F.lower("text"), F.lower("name"))
    hits = reduce(DataFrame.unionByName, [answers.join(p, has).select("answer_id", "name") for p in broadcast_blocks(names.select("name").distinct())])
    return hits.join(ends, F.lower("name") == F.col("k"), "left").select("answer_id", "name", F.when(F.col("g"), "grounded").otherwise("absent").alias("verdict"))


def isolation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the share of nodes without an edge, and whether it is over half."""
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct().withColumn("linked", F.lit(1))
    ratio = F.count_if(F.col("linked").isNull()) / F.count(F.lit(1))
    return nodes.select("node_id").join(ends, "node_id", "left").agg(F.round(ratio, 6).alias("ratio"), (ratio > 0.5).alias("regression"))


def compression(aliases: DataFrame) -> DataFrame:
    """One row: aliases by canonical entities."""
    return aliases.agg(F.round(F.count_distinct("alias") / F.count_distinct("entity_id"), 6).alias("ratio"))


def blocks(mentions: DataFrame, candidates: DataFrame, task_mentions: int = TASK_MENTIONS) -> DataFrame:
    """(mention_id, entity_id): candidates that start with the mention's first letter; a join on the letter.

    The result is as large as mentions by candidates of a letter.  Candidates are broadcast in parts, a list for each letter, and mentions are
    dealt to tasks of about task_mentions, since each is many rows; so none of the result is shuffled, spilled or looked up by itself.
    """
    key = lambda c: F.lower(F.substring(c, 1, 1))
    own = spread(mentions.select("mention_id", key("surface").alias("k")), task_mentions)
    parts = broadcast_blocks(candidates.select("entity_id", key("name").alias("k")))
    lists = [F.broadcast(part.groupBy("k").agg(F.collect_list(F.struct("entity_id")).alias("found"))) for part in parts]
    return reduce(DataFrame.unionByName, [own.join(found, "k").select("mention_id", F.inline("found")) for found in lists])


def reflect(generate: Callable[[DataFrame | None], DataFrame], evaluate: Callable[[DataFrame], DataFrame], rounds: int = 3) -> tuple[DataFrame, int]:
    """(accepted, rounds used): `generate` makes triples, from the rejected ones of the round before (none at first); `evaluate` adds
    the column approved; it ends when nothing is rejected, after `rounds` at most."""
    accepted, rejected = None, None
    for n in range(1, rounds + 1):
        judged = cut(evaluate(generate(rejected)))
        good = judged.filter("approved").drop("approved")
        accepted = good if accepted is None else accepted.unionByName(good)
        rejected = judged.filter("NOT approved").drop("approved")
        if not rejected.limit(1).count():
            break
    return accepted.distinct(), n
