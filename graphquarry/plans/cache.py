"""What was found in a text, kept by the text's hash: an append-only table that outlives builds.

A part is a folder of rows, by bucket of the hash: one row (hash, found) for each text that was looked through, found texts or not.  The parts that
count are listed in numbered files that are each made once (plans/commits.py), with the rows and a checksum of each part, so
writers may add at the same time, a part that is half written never counts, and a damaged one is known by its numbers.  Of rows that repeat
a hash any may be read, since equal texts give equal rows.  compact() makes one part of all.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import commits
from .materialise import broadcast_within, cut

LISTED = "number bigint, version_id string, parts string"
PREFIX = "part="


class Damaged(RuntimeError):
    """Parts whose rows are not those that were written."""


@dataclass
class Use:
    asked: int
    known: int
    looked_through: int


def _bucket(c: Column) -> Column:
    return F.lower(F.substring(c, 1, 1))


def listed(spark: SparkSession, path: str) -> dict[str, dict]:
    """{part: {"rows": n, "sum": checksum}} of the newest list."""
    rows = commits.published(spark, path, LISTED).orderBy(F.desc("number")).limit(1).collect()
    return json.loads(rows[0].parts) if rows else {}


def _publish(spark: SparkSession, path: str, change: Callable[[dict], dict], retries: int = 20) -> None:
    for _ in range(retries):
        number = commits.taken(spark, path) + 1
        parts = change(listed(spark, path))
        if commits.claim(spark, path, number, {"version_id": f"v{number}", "parts": json.dumps(parts, sort_keys=True)}):
            return
    raise RuntimeError(f"{path}: other writers were faster {retries} times")


def _numbers(rows: DataFrame, found: str) -> dict:
    """Rows and an order-free checksum of (hash, found)."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hash", F.to_json(F.struct(found)))).alias("x")).first()
    return {"rows": r.n, "sum": r.x or 0}


def read(spark: SparkSession, path: str, form: str, parts: list[str] | None = None) -> DataFrame:
    """(bucket, hash, found) of the parts that count; form is the type of found."""
    parts = sorted(listed(spark, path)) if parts is None else parts
    schema = f"hash string, found {form}, bucket string"
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{p}" for p in parts]).select("hash", "found", "bucket")


def _write(rows: DataFrame, path: str) -> str:
    name = f"{PREFIX}{uuid4().hex}"
    rows.select("hash", "found", _bucket(F.col("hash")).alias("bucket")).write.partitionBy("bucket").parquet(f"{path}/{name}")
    return name


def through(texts: DataFrame, path: str, form: str, look: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Use]:
    """(hash, found) of each distinct hash of texts (hash, content), and how many were known.

    look gets (hash, content) of the texts that no build has looked through, each once, and gives (hash, found); those it gives no row have a null.
    A part that is missing counts as unknown texts, so what it held is looked through again.
    """
    spark = texts.sparkSession
    asked = texts.select("hash").distinct()
    kept = read(spark, path, form)
    try:
        kept.limit(1).count()
    except AnalysisException:
        drop_damaged(spark, path, form)
        kept = read(spark, path, form)
    wanted = cut(asked.withColumn("bucket", _bucket(F.col("hash"))))
    known = cut(kept.join(broadcast_within(wanted, 200_000), ["bucket", "hash"]).select("hash", "found").dropDuplicates(["hash"]))
    new = texts.select("hash", "content").join(wanted.select("hash").join(known.select("hash"), "hash", "left_anti"), "hash", "left_semi").dropDuplicates(["hash"])
    new = cut(new)
    n = new.count()
    if n:
        found = new.select("hash").join(look(new), "hash", "left").select("hash", F.col("found"))
        part = _write(found, path)
        fresh = read(spark, path, form, [part])
        numbers = _numbers(fresh, "found")
        _publish(spark, path, lambda parts: parts | {part: numbers})
        known = known.unionByName(fresh.select("hash", "found"))
    return known, Use(wanted.count(), wanted.count() - n, n)


def integrity(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(part, rows, listed_rows, sound): whether each part has the rows that were written, by number and checksum."""
    out = []
    for part, numbers in sorted(listed(spark, path).items()):
        try:
            now = _numbers(read(spark, path, form, [part]), "found")
        except Exception:  # a file that is gone or can't be read
            now = {"rows": -1, "sum": 0}
        out.append((part, now["rows"], numbers["rows"], now == numbers))
    return spark.createDataFrame(out, "part string, rows bigint, listed_rows bigint, sound boolean")


def drop_damaged(spark: SparkSession, path: str, form: str) -> list[str]:
    """Take the parts that are not sound off the list; the next build looks through their texts again."""
    bad = [r.part for r in integrity(spark, path, form).filter("NOT sound").collect()]
    if bad:
        _publish(spark, path, lambda parts: {p: v for p, v in parts.items() if p not in bad})
    return bad


def compact(spark: SparkSession, path: str, form: str) -> str | None:
    """One part in the place of all; the name of it.  Refuses to carry damage over."""
    old = listed(spark, path)
    if len(old) < 2:
        return None
    if bad := [r.part for r in integrity(spark, path, form).filter("NOT sound").collect()]:
        raise Damaged(", ".join(bad))
    part = _write(read(spark, path, form, sorted(old)).dropDuplicates(["hash"]), path)
    numbers = _numbers(read(spark, path, form, [part]), "found")
    _publish(spark, path, lambda parts: {p: v for p, v in parts.items() if p not in old} | {part: numbers})
    return part


def sweep(spark: SparkSession, path: str, now: int, older: int = 86_400_000) -> list[str]:
    """Remove parts that are not listed and that nobody wrote to for `older` ms."""
    return commits.sweep(spark, path, set(listed(spark, path)), PREFIX, now - older)


def stats(spark: SparkSession, path: str, form: str) -> DataFrame:
    """One row: parts, rows, distinct texts."""
    parts = listed(spark, path)
    return read(spark, path, form).agg(F.lit(len(parts)).cast("bigint").alias("parts"), F.count(F.lit(1)).alias("rows"), F.countDistinct("hash").alias("texts"))
