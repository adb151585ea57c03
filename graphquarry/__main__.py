"""python -m graphquarry index SOURCE STORE | update SOURCE STORE | query STORE TEXT | search STORE TEXT | impact STORE PATTERN |
versions STORE | version STORE VERSION | diff STORE VERSION VERSION | rollback STORE VERSION | check STORE | sweep STORE | conversations SOURCE |
list-conversations SOURCE EDITOR | bookmarks STORE TEXT"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .plans import cache, maintain, results
from .sources import bookmarks, conversations, files

COMMANDS = {
    "index": ("source", "store"),
    "update": ("source", "store"),
    "query": ("store", "text"),
    "search": ("store", "text"),
    "impact": ("store", "pattern"),
    "versions": ("store",),
    "version": ("store", "version"),
    "diff": ("store", "old", "new"),
    "rollback": ("store", "version"),
    "check": ("store",),
    "sweep": ("store",),
    "conversations": ("source",),
    "list-conversations": ("source", "editor"),
    "bookmarks": ("store", "text"),
}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphquarry", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    for name, args in COMMANDS.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    asked = lambda: spark.createDataFrame([(0, a.text)], "query_id bigint, text string")
    if a.do in ("index", "update"):
        print(api.index(spark, files.project_root(a.source) if a.source == "." else a.source, a.store))
    elif a.do == "query":
        for r in api.ask(spark, a.store, asked()).orderBy("slot").toLocalIterator():
            print(f"## {r.path}\n\n{r.content}\n")
    elif a.do == "search":
        api.kept_search(spark, a.store, asked(), settings=api.Settings()).rows.orderBy("rank").select("rank", "score", "path", "title").show(50, False)
    elif a.do == "impact":
        api.impact(spark, a.store, a.pattern).orderBy("depth", "node").show(50, False)
    elif a.do == "versions":
        maintain.versions(spark, a.store).show(50, False)
    elif a.do == "version":
        maintain.versions(spark, a.store).filter(F.col("version_id") == a.version).show(1, False, True)
        maintain.changes(spark, a.store, a.version).orderBy("status", "path").show(50, False)
    elif a.do == "diff":
        maintain.difference(spark, a.store, a.old, a.new).orderBy("status", "path").show(50, False)
    elif a.do == "check":
        maintain.check(spark, a.store).show(50, False)
    elif a.do == "conversations":
        found = files.read_texts(spark, a.source).withColumn("format", conversations.log_format(F.col("path"), F.col("content")))
        found.filter("format IS NOT NULL").groupBy("format").count().orderBy("format").show(50, False)
    elif a.do == "list-conversations":
        found = files.read_texts(spark, a.source).filter(conversations.log_format(F.col("path"), F.col("content")) == a.editor)
        turns = conversations.conversations(found).groupBy("path", "conv_id", "title").agg(F.count(F.lit(1)).alias("turns"))
        turns.orderBy("path", "conv_id").show(50, False)
    elif a.do == "bookmarks":
        bookmarks.search(spark, a.store, a.text, 20).show(20, False)
    elif a.do == "sweep":
        now = int(time.time() * 1000)
        for name in [*maintain.sweep(spark, a.store, now), *results.sweep(spark, a.store, now), *cache.sweep(spark, f"{a.store}/cache", now)]:
            print(name)
    else:
        print(maintain.rollback(spark, a.store, a.version, int(time.time())))


if __name__ == "__main__":
    main()
