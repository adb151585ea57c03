"""Claims as a stream: each batch is compared with the latest claims so far, kept as a table of the last state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import claims as C

STATE = "claim_id bigint, entity string, attribute string, value double, valid_at string"


def _latest(claims: DataFrame) -> DataFrame:
    last = C.latest(claims)
    return last.select("claim_id", "entity", "attribute", "value", "valid_at")


def _read(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """The state that the batch before left; empty before the first."""
    return spark.createDataFrame([], STATE) if epoch == 0 else spark.read.schema(STATE).parquet(f"{path}/state/epoch={epoch - 1}")


def resolve_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Write the temporal edges that a batch adds, and the state after it, each in a folder of its epoch.

    The state holds one claim a key, so a batch costs its own size and one pass over the keys; a batch that is run again
    after a failure overwrites its own folders from the same state.  A claim that is older than the state's is late: it
    gives no edge, as the claim it would follow is gone.
    """
    spark = batch.sparkSession
    before = _read(spark, path, epoch)
    new = batch.select(*[F.col(c) for c in ("claim_id", "entity", "attribute", "value", "valid_at")])
    both = before.unionByName(new.withColumns({"entity": F.lower("entity"), "attribute": F.lower("attribute")})).persist()
    known = before.select(F.col("claim_id").alias("target"), F.lit(True).alias("old"))
    edges = C.temporal_edges(both).join(known.select(F.col("target").alias("source"), "old"), "source", "left").filter("old IS NULL").drop("old")
    edges.write.mode("overwrite").parquet(f"{path}/edges/epoch={epoch}")
    _latest(both).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
    both.unpersist()


def resolve_stream(claims: DataFrame, path: str) -> StreamingQuery:
    """Start resolving a stream of claims into `path`; one run takes what is there."""
    return claims.writeStream.foreachBatch(lambda batch, epoch: resolve_batch(batch, epoch, path)).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, type) of all batches."""
    return spark.read.parquet(f"{path}/edges").drop("epoch")
