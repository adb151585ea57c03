"""A store from files on disk: build, ask, update, versions, rollback."""

import pytest

from graphquarry import api
from graphquarry.operators import claims
from graphquarry.plans import maintain
from graphquarry.sources import bookmarks, conversations, files, store


def test_store_life(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "store")
    (src / "app").mkdir(parents=True)
    (src / "app" / "main.py").write_text("def startServer(config):\n    return loadConfig(config)\n")
    (src / "app" / "conf.py").write_text("def loadConfig(name):\n    return startServer\n")
    (src / "readme.md").write_text("# Guide\nHow the ServerGuide starts the server.\n")
    first = api.index(spark, str(src), path)
    assert (first.version_id, first.changed, first.added) == ("v1", True, 3)
    assert not api.index(spark, str(src), path).changed
    queries = spark.createDataFrame([(1, "loadConfig server"), (2, "nothing here matches zzz")], "query_id bigint, text string")
    hits = api.search(spark, path, queries).collect()
    assert hits and {h.query_id for h in hits} == {1} and any(h.path.endswith("conf.py") for h in hits)
    packed = api.ask(spark, path, queries, hops=1).collect()
    assert packed and {r.query_id for r in packed} == {1}
    before = {r.node_id for r in store.read_nodes(spark, maintain.generation(spark, path)).filter("path LIKE '%main.py'").collect()}
    (src / "app" / "conf.py").write_text("def loadConfig(name):\n    return 2\n")
    (src / "readme.md").unlink()
    second = api.index(spark, str(src), path)
    assert (second.version_id, second.added, second.modified, second.deleted) == ("v2", 0, 1, 1)
    nodes = store.read_nodes(spark, maintain.generation(spark, path))
    assert {r.node_id for r in nodes.filter("path LIKE '%main.py'").collect()} == before and nodes.filter("path LIKE '%readme%'").count() == 0
    assert maintain.rollback(spark, path, "v1", 1 << 40) == "v3" and maintain.generation(spark, path) == maintain.generation(spark, path, "v1")
    with pytest.raises(ValueError):
        maintain.rollback(spark, path, "v9", 1 << 41)
    assert maintain.check(spark, path).filter("`check` = 'dangling'").count() == 0
    assert [r.version_id for r in maintain.versions(spark, path).collect()] == ["v1", "v2", "v3"]


def test_updates_equal_a_whole_build(spark, tmp_path):
    """Every update writes its own rows only; the version it makes has the rows of a store built at once."""
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        (src / f"m{i}.py").write_text(f"def makePart{i}(x):\n    return makePart{(i + 1) % 6}(x) + sharedHelper(x)\n")
    (src / "helper.py").write_text("def sharedHelper(x):\n    return makePart3(x)\n")
    path = str(tmp_path / "store")
    api.index(spark, str(src), path)
    targets = {r.node for r in api.impact(spark, path, "helper.py", 1).filter("depth = 1").collect()}
    at = maintain.generation(spark, path)
    refer = {r.source for r in store.read_edges(spark, at).filter("type = 'reference'").collect()}
    assert targets and targets <= refer  # dependents come by reference edges
    calls = {(r.source, r.target) for r in store.read_edges(spark, at).filter("type = 'call'").collect()}
    assert calls and {s for s, _ in calls} <= refer and {(r.source, r.target) for r in store.read_edges(spark, at).filter("type = 'reference'").collect()} >= calls
    steps = [
        lambda: (src / "m2.py").write_text("def makePart2(x):\n    return otherThing(x)\n\ndef otherThing(x):\n    return sharedHelper(x)\n"),
        lambda: (src / "helper.py").unlink(),
        lambda: (src / "late.py").write_text("def sharedHelper(x):\n    return makePart0(x) + otherThing(x)\n"),
    ]
    for step in steps:
        step()
        assert api.index(spark, str(src), path).changed
    at = maintain.generation(spark, path)
    assert len(store.folders(at)) == 4
    whole = str(tmp_path / "whole")
    api.index(spark, str(src), whole)
    other = maintain.generation(spark, whole)
    for read in (store.read_nodes, store.read_edges, store.read_symbols, store.read_hashes, lambda s, a: store.read_index(s, a)[0], lambda s, a: store.read_index(s, a)[1]):
        x, y = read(spark, at), read(spark, other)
        columns = sorted(set(x.columns) - {"created_at"})
        assert sorted(map(repr, x.select(*columns).collect())) == sorted(map(repr, y.select(*columns).collect()))
    assert {(r.path.rsplit("/", 1)[-1], r.status) for r in maintain.changes(spark, path, "v3").collect()} == {("helper.py", "deleted")}
    fresh = spark.read.parquet(f"{path}/{maintain.version(spark, path, 'v2').own}/nodes")
    assert {r.path.rsplit("/", 1)[-1] for r in fresh.select("path").collect()} == {"m2.py"}


def test_edges_of_other_families(spark, tmp_path):
    """Edges that a builder gives for the nodes of a version: valid ones enter, those with a new end with an update, those of gone nodes go."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    of = lambda *names: spark.createDataFrame([(n, 50, f"# {n}\nThe text of {n} has some words of its own here.\n") for n in names], "path string, bytes long, content string")

    def flows(nodes):
        a, b = (nodes.select(F.col("node_id").alias(e), F.regexp_extract("path", r"(\d+)", 1).cast("int").alias(f"{e}_at")) for e in ("source", "target"))
        pairs = a.join(b, F.col("target_at") == F.col("source_at") + 1).select("source", "target")
        dangling = nodes.select(F.col("node_id").alias("source"), F.lit("nobody").alias("target"))
        return pairs.union(dangling).select("source", "target", F.lit("data_flow").alias("type"), F.lit(0.7).alias("score"), F.lit(0).cast("bigint").alias("ord"))

    def found():
        at = maintain.generation(spark, path)
        name = {r.node_id: r.path for r in store.read_nodes(spark, at).collect()}
        return sorted((name[r.source], name[r.target]) for r in store.read_edges(spark, at).filter("type = 'data_flow'").collect())

    maintain.update(spark, of("t1.md", "t2.md", "t4.md"), path, 1, more=flows)
    assert found() == [("t1.md", "t2.md")]
    maintain.update(spark, of("t1.md", "t2.md", "t3.md", "t4.md"), path, 2, more=flows)
    assert found() == [("t1.md", "t2.md"), ("t2.md", "t3.md"), ("t3.md", "t4.md")]
    maintain.update(spark, of("t1.md", "t3.md", "t4.md"), path, 3, more=flows)
    assert found() == [("t3.md", "t4.md")]


def test_classify(spark):
    q = spark.createDataFrame([(1, "who calls main"), (2, "hello")], "query_id int, text string")
    out = {r.query_id: r for r in api.classify(q).collect()}
    assert (out[1]["class"], out[1].tool) == ("code", "analyze_impact") and (out[2]["class"], out[2].tool) == ("text", None)


def test_claims_with_hot_keys_and_nulls(spark):
    rows = [(i, "Acme", "CEO", float(i % 3), f"2024-01-{1 + i // 40:02d}") for i in range(400)] + [(1000, None, "CEO", 1.0, None), (1001, None, "CEO", 2.0, "2024-01-01"), (1002, "Solo", "x", 1.0, "not a date")]
    c = spark.createDataFrame(rows, "claim_id long, entity string, attribute string, value double, valid_at string")
    got = {(r.source, r.target, r.type) for r in claims.temporal_edges(c).collect()}
    want = set()
    acme = sorted(rows[:400], key=lambda r: (r[4], r[0]))
    for a, b in zip(acme, acme[1:], strict=False):
        if a[4] < b[4]:
            want.add((b[0], a[0], "supersedes"))
            if a[3] != b[3]:
                want.add((b[0], a[0], "contradicts"))
    assert got == want
    arrived = {(r.source, r.target) for r in claims.stream_edges(c).filter("type = 'CONTRADICTS'").collect()}
    assert arrived == {(a[0], b[0]) for a, b in zip(rows[:400], rows[1:400], strict=False) if a[3] != b[3]} | {(1000, 1001)}


def test_search_settings(spark, tmp_path):
    src, path = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    for i, word in enumerate(("anchor", "beacon", "cipher")):
        (src / f"{word}.md").write_text(f"# {word}\nThe {word} of harbour number {i} has lights.\n")
    api.index(spark, str(src), path)
    q = spark.createDataFrame([(1, "beacon lights")], "query_id bigint, text string")
    for settings in (api.Settings(), api.Settings(dense=False), api.Settings(dense_weight=1.0)):
        best = api.search(spark, path, q, 3, settings).orderBy("rank").collect()
        assert best[0].path.endswith("beacon.md")
    kept = [api.kept_search(spark, path, q, 3) for _ in range(2)]
    assert [a.hit for a in kept] == [False, True] and [r.path for r in kept[1].rows.orderBy("rank").collect()] == [r.path for r in kept[0].rows.orderBy("rank").collect()]
    assert api.ask(spark, path, q, settings=api.Settings(expand=False)).count() > 0
    assert api.Settings.of({"dense": "off", "dense_weight": "0.5"}) == api.Settings(dense=False, dense_weight=0.5)
    assert api.Settings.of({"dense": "maybe", "dense_weight": "7", "expand": ""}) == api.Settings()
    assert api.backend() == api.backend("hash") == "hash"
    with pytest.raises(ValueError):
        api.backend("other")


def test_bookmarks(spark, tmp_path):
    path = str(tmp_path)
    assert bookmarks.bookmarks(spark, path).count() == 0
    rows = lambda *r: spark.createDataFrame(r, "node_id string, tag string, tag_tokens string, content string")
    bookmarks.upsert(rows(("a", "react-hooks", "react hooks", "state"), ("b", "auth", "auth", "login")), path)
    bookmarks.upsert(rows(("a", "react-hooks", "react hooks", "new state")), path)
    assert {(r.node_id, r.content) for r in bookmarks.bookmarks(spark, path).collect()} == {("a", "new state"), ("b", "login")}
    assert [r.node_id for r in bookmarks.search(spark, path, "react hooks", 5).collect()] == ["a"]
    bookmarks.delete(spark.createDataFrame([("b",)], "node_id string"), path)
    assert tuple(bookmarks.stats(spark, path).first()) == (1, 1, 9)
    bookmarks.clear(spark, path)
    assert bookmarks.bookmarks(spark, path).count() == 0
    bookmarks.upsert(rows(("b", "auth", "auth", "login")), path)
    assert [r.node_id for r in bookmarks.bookmarks(spark, path).collect()] == ["b"]


def test_conversations_become_files(spark, tmp_path):
    log = '{"id": "c/1", "title": "Talk", "messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "yes"}]}'
    conversations.ingest(spark.createDataFrame([("x/talk.aichat", log)], "path string, content string"), str(tmp_path / "md"))
    written = [f for f in (tmp_path / "md" / "conversation=c_1").iterdir() if f.name.startswith("part-")]
    assert len(written) == 1 and written[0].read_text().startswith("# Conversation: Talk") and "yes" in written[0].read_text()


def test_project_root(tmp_path):
    (tmp_path / "a" / "b" / "c").mkdir(parents=True)
    (tmp_path / "a" / "b" / "pyproject.toml").touch()
    assert files.project_root(str(tmp_path / "a" / "b" / "c")) == str((tmp_path / "a" / "b").resolve())
    (tmp_path / "a" / ".git").mkdir()
    assert files.project_root(str(tmp_path / "a" / "b" / "c")) == str((tmp_path / "a").resolve())


def test_reflection_and_reports(spark):
    made = []

    def generate(rejected):
        made.append(0 if rejected is None else rejected.count())
        return spark.createDataFrame([("a", "p", "b"), ("x", "q", "y")] if rejected is None else [("x", "p", "y")], "s string, p string, o string")

    accepted, rounds = claims.reflect(generate, lambda t: t.withColumn("approved", t.p == "p"))
    assert rounds == 2 and made == [0, 1] and {tuple(r) for r in accepted.collect()} == {("a", "p", "b"), ("x", "p", "y")}
    assert claims.reflect(lambda r: generate(None), lambda t: t.withColumn("approved", t.p == "p"))[1] == 3
    found = spark.createDataFrame([("low", f"m{i:02d}") for i in range(25)] + [("critical", "z")], "severity string, method string")
    out = api.shown(found).collect()
    assert len(out) == 11 and {(r.severity, r.hidden) for r in out} == {("low", 15), ("critical", 0)}


def test_commands(spark, tmp_path, capsys):
    from graphquarry.__main__ import main

    src, path = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "guide.md").write_text("# Guide\nThe lighthouse guide has words about lights and harbours.\n")
    (src / "talk.aichat").write_text('{"id": "c1", "title": "Talk", "messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "yes"}]}')
    main(["index", str(src), path])
    for _ in range(2):
        main(["search", path, "lighthouse"])
    main(["list-conversations", str(src), "cursor"])
    bookmarks.upsert(spark.createDataFrame([("n1", "light-house", "light house", "x")], "node_id string, tag string, tag_tokens string, content string"), path)
    main(["bookmarks", path, "light"])
    main(["sweep", path])
    out = capsys.readouterr().out
    assert out.count("guide.md") >= 2 and "Talk" in out and "n1" in out and "generation-" not in out.rsplit("n1", 1)[1]
