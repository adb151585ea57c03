"""Bookmarks as a log of Parquet rows: the last row of a node counts, and a cleared log counts from there on.

Rows are only appended, so a write costs its own rows; readers see a node once however often it was added.  Searches go by an index that each
write brings up to date (bookmark_index.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import bookmark_index

LOG = "seq bigint, node_id string, tag string, tag_tokens string, content string, gone boolean"
FIELDS = ("node_id", "tag", "tag_tokens", "content")


def _log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path}/bookmarks")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def _append(rows: DataFrame, path: str, gone: bool) -> None:
    seq = (_log(rows.sparkSession, path).agg(F.max("seq")).first()[0] or 0) + 1
    full = rows.select(F.lit(seq).cast("bigint").alias("seq"), *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FIELDS], F.lit(gone).alias("gone"))
    full.write.mode("append").parquet(f"{path}/bookmarks")


def upsert(rows: DataFrame, path: str) -> None:
    """Add bookmarks (node_id, tag, tag_tokens, content) or put them in the place of those with the same node."""
    _append(rows, path, False)
    bookmark_index.upsert(rows, path)


def delete(ids: DataFrame, path: str) -> None:
    _append(ids.select("node_id"), path, True)
    bookmark_index.delete(ids, path)


def clear(spark: SparkSession, path: str) -> None:
    _append(spark.createDataFrame([(None,)], "node_id string"), path, True)
    bookmark_index.clear(spark, path)


def bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """The bookmarks that the log amounts to."""
    log = _log(spark, path)
    cleared = log.filter("node_id IS NULL").agg(F.max("seq")).first()[0] or 0
    last = log.filter(F.col("node_id").isNotNull() & (F.col("seq") > cleared)).groupBy("node_id").agg(F.max_by(F.struct("tag", "tag_tokens", "content", "gone"), "seq").alias("l"))
    return last.filter("NOT l.gone").select("node_id", "l.tag", "l.tag_tokens", "l.content")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: bookmarks, distinct tags, characters of content."""
    return bookmarks(spark, path).agg(F.count(F.lit(1)).alias("bookmarks"), F.countDistinct("tag").alias("tags"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("characters"))


def search(spark: SparkSession, path: str, query: str, k: int) -> DataFrame:
    """(node_id, score) of the best bookmarks, from the kept index."""
    return bookmark_index.search(spark, path, query, k)
