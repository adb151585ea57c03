"""The kept bookmark index against a search that reads all bookmarks."""

import random

from graphquarry.sources import bookmark_index, bookmarks, store

FORM = "node_id string, tag string, tag_tokens string, content string"


def same(spark, path, queries):
    for q in queries:
        got = [(r.node_id, r.score) for r in bookmark_index.search(spark, path, q, 50).collect()]
        want = [(r.node_id, r.score) for r in store.bookmark_search(bookmarks.bookmarks(spark, path), q, 50).collect()]
        assert got == want, q


def test_the_index_follows_every_write(spark, tmp_path):
    path, rng = str(tmp_path), random.Random(4)
    words = ["auth", "token", "hooks", "react", "data", "file", "über"]
    row = lambda i: (f"n{i}", "-".join(rng.sample(words, 2)), " ".join(rng.sample(words, 3)), " ".join(rng.choices(words, k=rng.randrange(1, 9))) if i % 5 else None)
    queries = ["auth token", "react", "über data", "missing", "React auth"]
    assert bookmark_index.search(spark, path, "auth", 5).count() == 0
    bookmarks.upsert(spark.createDataFrame([row(i) for i in range(40)], FORM), path)
    same(spark, path, queries)
    bookmarks.upsert(spark.createDataFrame([row(i) for i in range(20, 50)], FORM), path)
    bookmarks.delete(spark.createDataFrame([("n3",), ("n30",), ("not there",)], "node_id string"), path)
    same(spark, path, queries)
    before = bookmark_index.state(spark, path)
    assert before["n"] == bookmarks.bookmarks(spark, path).count() == 48 and len(before["batches"]) == 3
    bookmark_index.compact(spark, path)
    after = bookmark_index.state(spark, path)
    assert len(after["batches"]) == 1 and (after["n"], after["sizes"]) == (before["n"], before["sizes"])
    same(spark, path, queries[:2])
    bookmarks.clear(spark, path)
    assert bookmark_index.search(spark, path, "auth", 5).count() == 0 and bookmark_index.state(spark, path)["n"] == 0
    bookmarks.upsert(spark.createDataFrame([row(1)], FORM), path)
    same(spark, path, queries[:1])


def test_a_search_reads_the_postings_of_its_words(spark, tmp_path):
    path = str(tmp_path)
    bookmark_index.upsert(spark.createDataFrame([(f"n{i}", f"t{i}", f"w{i} all", "x") for i in range(200)], FORM), path)
    found = bookmark_index.postings(spark, path, ["w7"], bookmark_index.state(spark, path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan
    assert [(r.node_id, r.field) for r in found.collect()] == [("n7", "tag_tokens")]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}) >= 1


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    bookmark_index.upsert(spark.createDataFrame([("a", "t", "one two", "x")], FORM), path)
    monkeypatch.setattr(bookmark_index.commits, "claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    try:
        bookmark_index.upsert(spark.createDataFrame([("a", "t", "three", "x"), ("b", "t", "one two", "x")], FORM), path)
    except KeyboardInterrupt:
        pass
    assert [r.node_id for r in bookmark_index.search(spark, path, "one two", 5).collect()] == ["a"]
