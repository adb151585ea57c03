"""Kept results: hits, misses after an update, age, rollback."""

import time

from graphquarry.plans import maintain, results


def files_of(spark, texts):
    return spark.createDataFrame([(k, len(v), v) for k, v in texts.items()], "path string, bytes long, content string")


def test_results_are_kept_for_a_version(spark, tmp_path):
    path, made = str(tmp_path / "s"), []
    maintain.update(spark, files_of(spark, {"a.md": "# a\nThe alphaOne text has lights and more words.\n"}), path, 1)
    q = spark.createDataFrame([(1, "x"), (2, None)], "query_id long, text string")

    def make():
        made.append(1)
        return q.selectExpr("query_id", "array(text) AS found", "map('k', query_id) AS m")

    ask = lambda now, queries=q, **settings: results.through(spark, path, "search", queries, settings, make, now)
    first = ask(1000)
    again = ask(2000, q.orderBy("text", ascending=False))
    assert (first.hit, again.hit, len(made)) == (False, True, 1)
    assert sorted(map(str, first.rows.collect())) == sorted(map(str, again.rows.collect())) == sorted(map(str, make().collect()))
    assert not ask(2000, k=5).hit and ask(2000, k=5).hit and not ask(2000, q.limit(1)).hit
    assert not ask(1000 + 86_400_001).hit and ask(1000 + 86_400_002).hit
    now = 1000 + 86_400_002
    maintain.update(spark, files_of(spark, {"b.md": "# b\nThe betaTwo text has other words in it.\n"}), path, 2)
    assert not ask(now).hit and ask(now).hit
    maintain.rollback(spark, path, "v1", 3)
    assert ask(now).hit
    later = int(time.time() * 1000) + 7_200_000
    gone = results.sweep(spark, path, later, keep_ms=later)
    assert len(gone) == 1  # the entry that was made anew for its age
    assert ask(now).hit and len(results.sweep(spark, path, later, keep_ms=1)) > 2
