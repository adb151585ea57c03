"""Writers of one store at the same time, and writers that die between any two writes."""

import threading
import time

import pytest

from graphquarry.plans import commits, maintain
from graphquarry.sources import store


def files_of(spark, texts):
    return spark.createDataFrame([(k, len(v), v) for k, v in texts.items()], "path string, bytes long, content string")


def state(spark, path):
    at = maintain.generation(spark, path)
    nodes = {(r.path, r.content) for r in store.read_nodes(spark, at).collect()}
    return nodes, {(r.path, r.hash) for r in store.read_hashes(spark, at).collect()}, {tuple(r) for r in store.read_edges(spark, at).select("source", "target", "type").collect()}


ONE = {"a.py": "def alphaOne(x):\n    return betaTwo(x)\n", "b.py": "def betaTwo(x):\n    return x\n"}
TWO = {"a.py": "def alphaOne(x):\n    return 1 + betaTwo(x)\n", "c.py": "def gammaThree(x):\n    return alphaOne(x)\n"}
THREE = {"b.py": ONE["b.py"], "d.py": "def deltaFour(x):\n    return betaTwo(x)\n"}


def test_a_claim_is_made_once(spark, tmp_path):
    won = []
    work = [threading.Thread(target=lambda i=i: commits.claim(spark, str(tmp_path), 1, {"version_id": f"by {i}"}) and won.append(i)) for i in range(8)]
    for t in work:
        t.start()
    for t in work:
        t.join()
    assert len(won) == 1 and commits.taken(spark, str(tmp_path)) == 1
    rows = commits.published(spark, str(tmp_path), "number bigint, version_id string").collect()
    assert [tuple(r) for r in rows] == [(1, f"by {won[0]}")]


def test_a_writer_that_was_overtaken_starts_again(spark, tmp_path):
    path, wholes = str(tmp_path / "s"), {}
    for name, texts in (("one", ONE), ("two", TWO), ("three", THREE)):
        maintain.update(spark, files_of(spark, texts), str(tmp_path / name), 1)
        wholes[name] = state(spark, str(tmp_path / name))
    maintain.update(spark, files_of(spark, ONE), path, 1)
    overtaken = []

    def publish_between(step):
        if step == "publish" and not overtaken:
            overtaken.append(maintain.update(spark, files_of(spark, THREE), path, 2).version_id)
            assert state(spark, path) == wholes["three"]

    done = maintain.update(spark, files_of(spark, TWO), path, 3, watch=publish_between)
    assert overtaken == ["v2"] and done.version_id == "v3" and (done.added, done.modified, done.deleted) == (2, 0, 2)
    assert state(spark, path) == wholes["two"]
    assert {(r.path, r.status) for r in maintain.changes(spark, path, "v3").collect()} == {("a.py", "added"), ("c.py", "added"), ("b.py", "deleted"), ("d.py", "deleted")}
    # the prepared rows of the lost attempt are nobody's
    assert maintain.sweep(spark, path, 0) == []
    assert len(maintain.sweep(spark, path, int(time.time() * 1000) + 1000, older=0)) == 1
    assert state(spark, path) == wholes["two"]
    with pytest.raises(maintain.Overtaken):
        maintain.update(spark, files_of(spark, ONE), path, 4, retries=0, watch=lambda s: s == "publish" and commits.claim(spark, path, commits.taken(spark, path) + 1, {}))


def test_a_writer_that_dies_leaves_the_version_as_it_was(spark, tmp_path):
    path = str(tmp_path / "s")
    maintain.update(spark, files_of(spark, ONE), path, 1)
    before, steps = state(spark, path), []
    maintain.update(spark, files_of(spark, TWO), str(tmp_path / "w"), 1)
    whole = state(spark, str(tmp_path / "w"))
    maintain.update(spark, files_of(spark, ONE), str(tmp_path / "x"), 1)
    maintain.update(spark, files_of(spark, TWO), str(tmp_path / "x"), 2, watch=steps.append)
    assert steps == ["nodes", "symbols", "hashes", "index", "vectors", "gone", "edges", "changes", "publish"]

    for at in steps:

        def die(step, at=at):
            if step == at:
                raise KeyboardInterrupt

        with pytest.raises(KeyboardInterrupt):
            maintain.update(spark, files_of(spark, TWO), path, 2, watch=die)
        assert [r.version_id for r in maintain.versions(spark, path).collect()] == ["v1"]
    assert state(spark, path) == before
    assert maintain.update(spark, files_of(spark, TWO), path, 3).version_id == "v2" and state(spark, path) == whole
    assert len(maintain.sweep(spark, path, int(time.time() * 1000) + 1000, older=0)) == len(steps) - 1  # the first wrote nothing
    assert state(spark, path) == whole


def test_a_claim_without_content_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "s")
    maintain.update(spark, files_of(spark, ONE), path, 1)
    (tmp_path / "s" / "versions" / "v2.json").touch()
    assert maintain.version(spark, path).version_id == "v1"
    assert maintain.update(spark, files_of(spark, TWO), path, 2).version_id == "v3"
    assert maintain.rollback(spark, path, "v1", 3) == "v4" and maintain.changes(spark, path, "v4").count() == 0
    assert [r.version_id for r in maintain.versions(spark, path).collect()] == ["v1", "v3", "v4"]
