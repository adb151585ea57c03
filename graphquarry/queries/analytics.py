"""Analytics queries over the events table, which stands for time-stamped mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..streaming import mentions as S
from .registry import model, query, sql, table

AS_OF = "TIMESTAMP '2024-01-25 00:00:00'"
_ITEMS = "SELECT ts, event_type || '-' || (user_id % 13) || CASE WHEN event_id % 100 = 3 AND ts >= TIMESTAMP '2024-01-20 00:00:00' THEN '-new' ELSE '' END AS entity, event_type AS topic FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00' AND (user_id % 13 <> 5 OR ts >= TIMESTAMP '2024-01-18 00:00:00')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _ITEMS)


@query(f"WITH it AS ({_ITEMS}), c AS (SELECT entity, count(*) AS n FROM it WHERE ts >= {AS_OF} - INTERVAL 7 DAYS GROUP BY entity ORDER BY n DESC, entity LIMIT 20) SELECT * FROM c WHERE n >= 2")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities most mentioned in a week."""
    return A.trending(_items(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 7 DAYS"), "entity", 20)


@query(f"WITH it AS ({_ITEMS}), c AS (SELECT topic, count(*) AS n FROM it WHERE ts >= {AS_OF} - INTERVAL 7 DAYS GROUP BY topic ORDER BY n DESC, topic LIMIT 10) SELECT * FROM c WHERE n >= 2")
def trending_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics most mentioned in a week."""
    return A.trending(_items(spark, sf_dir), F.expr(f"{AS_OF} - INTERVAL 7 DAYS"), "topic", 10)


@query(
    f"""WITH it AS ({_ITEMS}), c AS (SELECT entity, count(*) FILTER (ts >= {AS_OF} - INTERVAL 7 DAYS) AS r, count(*) FILTER (ts < {AS_OF} - INTERVAL 7 DAYS) AS b FROM it WHERE ts >= {AS_OF} - INTERVAL 30 DAYS GROUP BY entity),
g AS (SELECT entity, CASE WHEN b > 0 THEN (r - b) / b WHEN r > 1 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS growth FROM c WHERE r > 0) SELECT * FROM g WHERE growth > 0.5 ORDER BY growth DESC, entity LIMIT 10"""
)
def emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: entities that grew against the weeks before."""
    return A.emerging(_items(spark, sf_dir), "entity", F.expr(AS_OF))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE contains(lower(event_type), 'clic') GROUP BY 1")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a topic by day."""
    return A.timeline(table(spark, sf_dir, "events").filter(F.contains(F.lower("event_type"), F.lit("clic"))))


_V = "SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value > 0"


@query(
    f"""WITH v AS ({_V}), m AS (SELECT min(v) AS lo, (max(v) - min(v)) / 12 AS w FROM v), c AS (SELECT least(CAST(floor((v - lo) / w) AS INT), 11) AS b, count(*) AS n FROM v, m GROUP BY 1)
SELECT CAST(r.b AS INT) AS bucket, round(lo + r.b * w, 6) AS start, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS b) r CROSS JOIN m LEFT JOIN c ON c.b = r.b"""
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal widths with empty buckets."""
    return A.histogram(sql(spark, sf_dir, _V), "v", 12).withColumn("start", F.round("start", 6))


@query("SELECT type, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM nodes GROUP BY type")
def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and tokens by type."""
    return A.type_counts(model(spark, sf_dir, "nodes"))


@query(
    """WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM o)
SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of A11: runs of a user's events without an hour's gap."""
    return A.sessions(table(spark, sf_dir, "events"), 3600).select("user_id", "session", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of A11: tumbling windows, by the plan that the stream runs too."""
    out = S.windowed(table(spark, sf_dir, "events"), "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension of A11: the same windows from a stream of the events file, run to its end."""
    return S.replayed(spark, sf_dir).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
