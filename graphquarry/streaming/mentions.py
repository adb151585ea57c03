"""Windowed mention counts and claim changes as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import ensure_checkpoint_dir

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n) in tumbling windows; `late` sets a watermark on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def replayed(spark: SparkSession, sf_dir: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Stream the events file to its end and return all windows, from files in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/mentions-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    # A file source takes a folder or a pattern; the brackets make a plain file a pattern.
    stream = spark.readStream.schema(SCHEMA).parquet(path[:-1] + "[t]")
    counts = windowed(stream, width, late)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{at}/out")
    newest = last.agg(F.max("epoch")).first()[0]
    return last.filter(F.col("epoch") == newest).drop("epoch")
