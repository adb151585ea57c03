"""Conversation analytics: trending, emerging, timelines, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trending(items: DataFrame, since: Column, name: str, k: int, least: int = 2) -> DataFrame:
    """(name, n): the k most counted values since a time that count at least `least`; ties by name."""
    counts = items.filter(F.col("ts") >= since).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), name).limit(k).filter(F.col("n") >= least)


def emerging(items: DataFrame, name: str, as_of: Column, recent_days: int = 7, baseline_days: int = 30, k: int = 10) -> DataFrame:
    """(name, growth): values whose recent count grew over half against the baseline window; new ones of two and more
    grow without bound.  One aggregation for both windows."""
    recent, start = as_of - F.expr(f"INTERVAL {recent_days} DAYS"), as_of - F.expr(f"INTERVAL {baseline_days} DAYS")
    counts = items.filter(F.col("ts") >= start).groupBy(name).agg(F.count_if(F.col("ts") >= recent).alias("r"), F.count_if(F.col("ts") < recent).alias("b"))
    growth = F.when(F.col("b") > 0, (F.col("r") - F.col("b")) / F.greatest("b", F.lit(1))).when(F.col("r") > 1, float("inf")).otherwise(0.0)
    return counts.filter("r > 0").select(name, growth.alias("growth")).filter("growth > 0.5").orderBy(F.desc("growth"), name).limit(k)


def timeline(items: DataFrame) -> DataFrame:
    """(day, n): mentions a day."""
    return items.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def histogram(items: DataFrame, value: str, k: int) -> DataFrame:
    """(bucket, start, n): k equal widths from least to greatest, the last closed, empty ones kept."""
    low, high = items.agg(F.min(value), F.max(value)).first()
    if low is None:
        return items.sparkSession.createDataFrame([], "bucket int, start double, n bigint")
    width = (high - low) / k
    bucket = F.least(F.floor((F.col(value) - low) / width).cast("int"), F.lit(k - 1)) if width > 0 else F.lit(0)
    counts = items.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = items.sparkSession.range(k).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", (F.lit(low) + F.col("bucket") * F.lit(width)).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n, tokens): nodes and tokens of each type."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").cast("bigint").alias("tokens"))


def language_stats(files: DataFrame) -> DataFrame:
    """(language, files, lines, mb) of classified files (language, lines, bytes)."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.round(F.sum("bytes") / 1048576, 6).alias("mb"))


def sessions(events: DataFrame, gap_seconds: int, block_seconds: int = 3600) -> DataFrame:
    """(user_id, session, n, first, last): runs of a user's events without a gap of gap_seconds.

    Events are compared and numbered inside blocks of time, and mended by small tables of (user, block), so a user with a large share
    of all events is spread over tasks.  Events without a time are of the first session.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.withColumn("at", at).withColumn("block", F.coalesce(F.floor(F.col("at") / (block_seconds * 1_000_000)), F.lit(-(1 << 62))))
    key, blocks = ("user_id", "block"), W.partitionBy("user_id").orderBy("block")

    def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
        totals = totals.withColumnsRenamed({k: f"of_{k}" for k in key})
        return rows.join(totals, rows.user_id.eqNullSafe(F.col("of_user_id")) & (rows.block == F.col("of_block"))).drop(*[f"of_{k}" for k in key])

    ends = own.groupBy(*key).agg(F.max("at").alias("last_at")).select(*key, F.lag("last_at").over(blocks).alias("before"))
    inside = W.partitionBy(*key).orderBy("ts", "event_id")
    rows = with_totals(own, ends)
    rows = rows.withColumn("new", F.coalesce((F.col("at") - F.coalesce(F.lag("at").over(inside), "before") > gap_seconds * 1_000_000).cast("int"), F.lit(0)))
    rows = rows.withColumn("local", F.sum("new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    offsets = rows.groupBy(*key).agg(F.sum("new").alias("k")).select(*key, F.coalesce(F.sum("k").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = with_totals(rows, offsets).withColumn("session", F.col("offset") + F.col("local"))
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
