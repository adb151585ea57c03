"""Cutting lineage in shared storage, and broadcasts whose size is checked."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; make one only in local mode, where it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="graphquarry-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, which survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a materialised table if it has at most max_rows rows; beyond, leave a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_blocks(df: DataFrame, max_rows: int = 100_000) -> list[DataFrame]:
    """df in hash-dealt parts of about max_rows / 2 rows, each to be broadcast.

    For joins without an equal key (substrings, patterns), where the other side is read once for each part.
    """
    df = cut(df)
    k = max(1, -(-2 * df.count() // max_rows))
    if k == 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(k)) == i)) for i in range(k)]


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df over as many partitions as there are cores, or as parts of `rows` rows, if its scan gives fewer (one small file with one row
    group); a scan that already feeds them all is left as it is, without a shuffle."""
    most = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        most = max(most, -(-df.count() // rows))
    return df.repartition(most) if df.rdd.getNumPartitions() < most else df
