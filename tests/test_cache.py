"""The kept cache: what is looked through, what a damaged part costs, compaction."""

import shutil
import threading

import pytest

from graphquarry.plans import cache

FORM = "array<string>"


def texts_of(spark, words):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(w,) for w in words], "content string").select(F.sha1("content").alias("hash"), "content")


def through(spark, path, words, seen):
    from pyspark.sql import functions as F

    def look(t):
        seen.append(sorted(r.content for r in t.collect()))
        return t.filter("content <> 'nothing'").select("hash", F.array(F.upper("content")).alias("found"))

    t = texts_of(spark, words)
    known, use = cache.through(t, path, FORM, look)
    return {r.content: r.found for r in t.join(known, "hash").collect()}, use


def test_only_new_texts_are_looked_through(spark, tmp_path):
    path, seen = str(tmp_path / "c"), []
    out, use = through(spark, path, ["a", "b", "b", "nothing"], seen)
    assert out == {"a": ["A"], "b": ["B"], "nothing": None} and use == cache.Use(3, 0, 3) and seen == [["a", "b", "nothing"]]
    out, use = through(spark, path, ["b", "nothing", "c"], seen)
    assert out == {"b": ["B"], "nothing": None, "c": ["C"]} and use == cache.Use(3, 2, 1) and seen[1:] == [["c"]]
    assert through(spark, path, ["a", "c"], seen)[1] == cache.Use(2, 2, 0) and len(seen) == 2
    assert through(spark, path, [], seen)[1] == cache.Use(0, 0, 0)
    assert tuple(cache.stats(spark, path, FORM).first()) == (2, 4, 4)


def test_damage_is_found_and_looked_through_again(spark, tmp_path):
    path, seen = str(tmp_path / "c"), []
    through(spark, path, ["a", "b"], seen)
    through(spark, path, ["c", "d"], seen)
    assert [r.sound for r in cache.integrity(spark, path, FORM).collect()] == [True, True]
    part = next(r.part for r in cache.integrity(spark, path, FORM).collect())
    shutil.rmtree(next((tmp_path / "c" / part).glob("bucket=*")))
    assert sorted(r.sound for r in cache.integrity(spark, path, FORM).collect()) == [False, True]
    with pytest.raises(cache.Damaged):
        cache.compact(spark, path, FORM)
    assert cache.drop_damaged(spark, path, FORM) == [part]
    out, use = through(spark, path, ["a", "b", "c", "d"], seen)
    assert out == {w: [w.upper()] for w in "abcd"} and use == cache.Use(4, 2, 2)


def test_compaction_and_writers_at_the_same_time(spark, tmp_path):
    path, seen = str(tmp_path / "c"), []
    work = [threading.Thread(target=through, args=(spark, path, [f"w{i}", "same"], seen)) for i in range(4)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert len(cache.listed(spark, path)) == 4 and cache.stats(spark, path, FORM).first().texts == 5
    before = len(seen)
    assert cache.compact(spark, path, FORM) is not None and cache.compact(spark, path, FORM) is None
    assert tuple(cache.stats(spark, path, FORM).first()) == (1, 5, 5)
    assert through(spark, path, ["w0", "w1", "w2", "w3", "same"], seen)[1] == cache.Use(5, 5, 0) and len(seen) == before
    import time

    assert len(cache.sweep(spark, path, int(time.time() * 1000) + 1000, older=0)) == 4
    assert cache.stats(spark, path, FORM).first().texts == 5
