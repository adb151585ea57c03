"""Versions of a store as files that are each made once, by any number of writers.

A version is one file, versions/v<number>.json.  A writer prepares its rows in folders of its own, then claims the next number by making that file,
which fails if it is there; the loser looks at the store anew.  So a version is either whole or not there, and versions form one line.  On a local disk
the file appears with its content (a hard link); elsewhere Hadoop's create-without-overwrite takes the name first, so a writer that dies
within the write leaves a number without content, which readers pass over and the next writer skips.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """A path of Hadoop and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, time of the last change in ms) of what is in a folder; nothing of one that is not there."""
    p, fs = _at(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def claim(spark: SparkSession, path: str, number: int, row: dict) -> bool:
    """Make version `number` of the store unless it is there; whether this call made it."""
    text = json.dumps(row | {"number": number})
    p, fs = _at(spark, f"{path}/versions/v{number}.json")
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":
        target = unquote(urlparse(fs.makeQualified(p).toString()).path)
        held = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(held, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(held, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(held)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def taken(spark: SparkSession, path: str) -> int:
    """The highest number that a writer has claimed, with content or without; 0 for none."""
    return max((int(m[1]) for n, _ in names(spark, f"{path}/versions") if (m := re.fullmatch(r"v(\d+)\.json", n))), default=0)


def published(spark: SparkSession, path: str, form: str) -> DataFrame:
    """The versions that have content, by number."""
    if not taken(spark, path):
        return spark.createDataFrame([], form)
    return spark.read.schema(form).json(f"{path}/versions").filter("version_id IS NOT NULL").orderBy("number")


def sweep(spark: SparkSession, path: str, used: set[str], prefix: str, older_than: int) -> list[str]:
    """Remove the folders that begin with prefix, are not used and were last changed before older_than (ms); their names.

    A writer may still be at work in a younger one.
    """
    gone = []
    for name, changed in names(spark, path):
        if name.startswith(prefix) and name not in used and changed < older_than:
            p, fs = _at(spark, f"{path}/{name}")
            if fs.delete(p, True):
                gone.append(name)
    return sorted(gone)
