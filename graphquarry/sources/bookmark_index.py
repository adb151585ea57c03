"""A kept inverted index of bookmarks, by field and word, that follows upserts, deletions and clearing.

A write adds a batch: the postings and lengths of its bookmarks, and tombstones for what they replace in earlier batches.  Then it publishes a
state that is made once (plans/commits.py): the batches that count, how many bookmarks live and how long their fields are.  So a
search reads the state, the postings of the query's words (by bucket of the word and pushed filters) and tombstones, never the bookmarks; clearing
publishes a state without batches; and a write that dies, or loses to another one, changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import commits
from ..plans.materialise import broadcast_within, cut

FIELDS = ("tag_tokens", "tag", "content")
BUCKETS, MOST_BATCHES = 16, 12
K1, B = 1.2, 0.75
STATE = "number bigint, version_id string, state string"
POSTINGS = "node_id string, field string, term string, tf bigint, size bigint"
LENGTHS = "node_id string, " + ", ".join(f"{f} bigint" for f in FIELDS)
GONE = "node_id string, of string"
_EMPTY = {"batches": [], "n": 0, "sizes": dict.fromkeys(FIELDS, 0)}


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def state(spark: SparkSession, path: str) -> dict:
    rows = commits.published(spark, f"{path}/bookmark_index", STATE).orderBy(F.desc("number")).limit(1).collect()
    return json.loads(rows[0].state) if rows else _EMPTY


def _read(spark: SparkSession, path: str, batches: list[str], table: str, form: str) -> DataFrame:
    """Rows of a table of these batches, with their batch."""
    if not batches:
        return spark.createDataFrame([], f"{form}, batch string" + (", bucket int" if table == "postings" else ""))
    at = f"{path}/bookmark_index/{table}"
    schema = f"{form}, batch string" + (", bucket int" if table == "postings" else "")
    return spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/batch={b}" for b in batches])


def _gone(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    return _read(spark, path, batches, "gone", GONE).select("node_id", F.col("of").alias("batch")).distinct()


def _living(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone, ["node_id", "batch"], "left_anti").select(*rows.columns)


def lengths(spark: SparkSession, path: str, now: dict) -> DataFrame:
    """(node_id, sizes of the fields.., batch) of living bookmarks."""
    return _living(_read(spark, path, now["batches"], "lengths", LENGTHS), _gone(spark, path, now["batches"]))


def _publish(spark: SparkSession, path: str, prepare: Callable[[dict], dict], retries: int = 10) -> None:
    for _ in range(retries):
        number = commits.taken(spark, f"{path}/bookmark_index") + 1
        now = prepare(state(spark, path))
        if commits.claim(spark, f"{path}/bookmark_index", number, {"version_id": f"v{number}", "state": json.dumps(now)}):
            return
    raise RuntimeError(f"{path}: other writers were faster {retries} times")


def _totals(rows: DataFrame) -> tuple[int, dict]:
    r = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FIELDS]).first()
    return r.n, {f: r[f] for f in FIELDS}


def _write_batch(rows: DataFrame, path: str) -> str:
    """The postings and lengths of bookmarks (node_id, tag_tokens, tag, content)."""
    batch, at = uuid4().hex, f"{path}/bookmark_index"
    sized = rows.select("node_id", *[words(F.col(f)).alias(f) for f in FIELDS])
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("w")) for f in FIELDS])
    terms = sized.select("node_id", F.inline(fields)).select("node_id", "field", F.size("w").cast("bigint").alias("size"), F.explode("w").alias("term"))
    posts = terms.groupBy("node_id", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size")).withColumn("bucket", _bucket(F.col("term")))
    posts.repartition("bucket").sortWithinPartitions("bucket", "term", "node_id").select(*[c.split()[0] for c in POSTINGS.split(", ")], "bucket").write.partitionBy("bucket").parquet(f"{at}/postings/batch={batch}")
    sized.select("node_id", *[F.size(f).cast("bigint").alias(f) for f in FIELDS]).write.parquet(f"{at}/lengths/batch={batch}")
    return batch


def _replaced(spark: SparkSession, path: str, now: dict, ids: DataFrame, batch: str) -> tuple[int, dict]:
    """Tombstones of the living bookmarks with these ids, written with the batch; how many they are and how long."""
    old = cut(lengths(spark, path, now).join(broadcast_within(ids, 200_000), "node_id", "left_semi"))
    old.select("node_id", F.col("batch").alias("of")).write.parquet(f"{path}/bookmark_index/gone/batch={batch}")
    return _totals(old)


def upsert(rows: DataFrame, path: str) -> None:
    """Add bookmarks, the last one of each node of the rows, in the place of those with their nodes."""
    spark = rows.sparkSession
    own = cut(rows.select("node_id", *FIELDS).dropDuplicates(["node_id"]))

    def prepare(now: dict) -> dict:
        batch = _write_batch(own, path)
        n, sizes = _totals(spark.read.schema(LENGTHS).parquet(f"{path}/bookmark_index/lengths/batch={batch}"))
        m, old = _replaced(spark, path, now, own.select("node_id"), batch)
        return {"batches": [*now["batches"], batch], "n": now["n"] + n - m, "sizes": {f: now["sizes"][f] + sizes[f] - old[f] for f in FIELDS}}

    _publish(spark, path, prepare)
    if len(state(spark, path)["batches"]) > MOST_BATCHES:
        compact(spark, path)


def delete(ids: DataFrame, path: str) -> None:
    spark = ids.sparkSession
    own = cut(ids.select("node_id").distinct())

    def prepare(now: dict) -> dict:
        batch = _write_batch(spark.createDataFrame([], "node_id string, tag_tokens string, tag string, content string"), path)
        m, old = _replaced(spark, path, now, own, batch)
        return {"batches": [*now["batches"], batch], "n": now["n"] - m, "sizes": {f: now["sizes"][f] - old[f] for f in FIELDS}}

    _publish(spark, path, prepare)


def clear(spark: SparkSession, path: str) -> None:
    _publish(spark, path, lambda now: _EMPTY)


def compact(spark: SparkSession, path: str) -> None:
    """One batch of all living postings, without tombstones."""

    def prepare(now: dict) -> dict:
        batch, at = uuid4().hex, f"{path}/bookmark_index"
        gone = _gone(spark, path, now["batches"])
        posts = _living(_read(spark, path, now["batches"], "postings", POSTINGS), gone).drop("batch")
        posts.repartition("bucket").sortWithinPartitions("bucket", "term", "node_id").write.partitionBy("bucket").parquet(f"{at}/postings/batch={batch}")
        lengths(spark, path, now).drop("batch").write.parquet(f"{at}/lengths/batch={batch}")
        spark.createDataFrame([], GONE).write.parquet(f"{at}/gone/batch={batch}")
        return now | {"batches": [batch]}

    _publish(spark, path, prepare)


def postings(spark: SparkSession, path: str, terms: list[str], now: dict) -> DataFrame:
    """Living postings of these words; only the buckets of the words are listed, and the filter on the word is pushed to the scan."""
    buckets = [r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t")).alias("b")).distinct().collect()]
    found = _read(spark, path, now["batches"], "postings", POSTINGS).filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms))
    return _living(found, _gone(spark, path, now["batches"]))


def search(spark: SparkSession, path: str, query: str, k: int) -> DataFrame:
    """(node_id, score): bookmarks that have all query words in one field, by BM25 summed over the fields that match."""
    asked = list(dict.fromkeys(query.lower().split()))
    now = state(spark, path)
    if not asked or not now["n"]:
        return spark.createDataFrame([], "node_id string, score double")
    posts = postings(spark, path, asked, now)
    df = posts.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    mean = F.create_map(*[F.lit(x) for f in FIELDS for x in (f, now["sizes"][f] / now["n"])])[F.col("field")]
    idf = F.log((now["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    fields = posts.join(F.broadcast(df), ["field", "term"]).groupBy("node_id", "field").agg(F.count(F.lit(1)).alias("hits"), F.sum(score).alias("score"))
    total = fields.filter(F.col("hits") == len(asked)).groupBy("node_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return total.orderBy(F.desc("score"), "node_id").limit(k)
