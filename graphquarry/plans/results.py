"""Results of searches, kept as tables by what was asked of which version of a store.

A key is a hash of the request (a name, its parameters, and the rows of its table of queries, whatever their order) and of the generations that
the store's version is made of.  So an update of the store makes every earlier result miss without anybody telling the cache, and a rollback makes
the results of its generations hit again.  A result is published by one file that is made once (plans/commits.py), with the time it was made:
two writers keep one of their equal results, and one that dies leaves a folder that sweep() removes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits, maintain

ENTRY = "number bigint, version_id string, made bigint, folder string, schema string, generation string"
PREFIX = "rows-"


@dataclass
class Answer:
    rows: DataFrame
    hit: bool


def fingerprint(queries: DataFrame) -> str:
    """Of the rows of a table and its columns, in any order."""
    names = sorted(queries.columns)
    h = F.xxhash64(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names]), {"ignoreNullFields": "false"}))
    r = queries.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("s")).first()
    return hashlib.sha256(json.dumps([names, r.n, r.x, r.s]).encode()).hexdigest()


def key_of(spark: SparkSession, path: str, name: str, queries: DataFrame, settings: dict) -> tuple[str, str]:
    """The key of a request now, and the generations it is for."""
    row = maintain.version(spark, path)
    generation = row.generation if row else ""
    return hashlib.sha256(json.dumps([name, settings, fingerprint(queries), generation], sort_keys=True).encode()).hexdigest()[:40], generation


def through(spark: SparkSession, path: str, name: str, queries: DataFrame, settings: dict, make: Callable[[], DataFrame], now: int, keep_ms: int = 86_400_000) -> Answer:
    """The kept rows of a request, or those that make() gives, kept from now on; entries made more than keep_ms before `now` don't count."""
    key, generation = key_of(spark, path, name, queries, settings)
    at = f"{path}/results/{key}"
    last = commits.published(spark, at, ENTRY).orderBy(F.desc("number")).limit(1).collect()
    if last and last[0].made > now - keep_ms:
        return Answer(spark.read.schema(last[0].schema).parquet(f"{path}/results/{last[0].folder}"), True)
    folder = f"{PREFIX}{uuid4().hex}"
    rows = make()
    rows.write.parquet(f"{path}/results/{folder}")
    number = commits.taken(spark, at) + 1
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    commits.claim(spark, at, number, {"version_id": key, "made": now, "folder": folder, "schema": schema, "generation": generation})
    return Answer(spark.read.schema(schema).parquet(f"{path}/results/{folder}"), False)


def sweep(spark: SparkSession, path: str, now: int, keep_ms: int = 86_400_000) -> list[str]:
    """Remove the rows of entries that are too old or of generations that no version has any longer, and what dead writers left; their names.

    Younger folders stay, since their entry may be about to be published.
    """
    live = {r.generation for r in maintain.versions(spark, path).select("generation").collect()}
    used = set()
    for name, _ in commits.names(spark, f"{path}/results"):
        if not name.startswith(PREFIX):
            for r in commits.published(spark, f"{path}/results/{name}", ENTRY).orderBy(F.desc("number")).limit(1).collect():
                if r.generation in live and r.made > now - keep_ms:
                    used.add(r.folder)
    return commits.sweep(spark, f"{path}/results", used, PREFIX, now - 3_600_000)
