"""GraphML documents, written and read back; partitions that grow in number and not in size."""

from graphquarry import schema
from graphquarry.plans.materialise import spread
from graphquarry.sources import exports, store

_ROWS = [("1:a", "CALL", " two words ", "x &lt; <y>\n", "a.py", 3, 0, ""), ("1:b", "CALL", "", None, None, None, 1, "")]


def _graph(spark):
    return spark.createDataFrame(_ROWS, schema.CPG_NODES), spark.createDataFrame([("1:a", "1:b", "AST"), ("1:a", "1:b", "AST"), ("1:b", "2:z", "CFG")], schema.CPG_EDGES)


def test_values_keep_their_spaces(spark, tmp_path):
    nodes, edges = _graph(spark)
    for form in ("graphml", "graphson", "neo4jcsv"):
        exports.write(nodes, edges, str(tmp_path), form)
        n, e = exports.read(spark, str(tmp_path), form)
        empty = None if form == "graphml" else ""
        assert sorted(n.select("id", "label", "name", "code", "filename", "line").collect()) == [("1:a", "CALL", " two words ", "x &lt; <y>\n", "a.py", 3), ("1:b", "CALL", empty, None, None, None)]
        assert sorted(e.select("src", "dst", "label").distinct().collect()) == [("1:a", "1:b", "AST"), ("1:b", "2:z", "CFG")]


def test_exports_are_small_and_read_in_place(spark, tmp_path):
    """A file is gzipped, and nodes and edges that repeat are found in their document, without a shuffle."""
    some = spark.range(3000).selectExpr("concat(id, ':a') AS id", "'CALL' AS label", "concat('f', id) AS name", "'run(cmd)' AS code", "'a.py' AS filename", "3 AS line", "0 AS idx", "'' AS type_full_name")
    edges = some.selectExpr("id AS src", "'0:a' AS dst", "'AST' AS label")
    for form in ("graphml", "graphson", "neo4jcsv"):
        exports.write(some.unionByName(some.limit(5)), edges.union(edges), str(tmp_path), form)
        files = [p for p in (tmp_path / form).rglob("part-*") if p.is_file()]
        assert files and all(p.suffix == ".gz" for p in files)
    nodes, found = exports.read(spark, str(tmp_path), "graphml")
    for df in (nodes, found):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 3000 and df.distinct().count() == 3000
    assert nodes.filter("id = '7:a'").select("label", "name", "code", "filename", "line").collect() == [("CALL", "f7", "run(cmd)", "a.py", 3)]


def test_odd_documents(spark):
    named = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph><node id="a"><data key="labelV">{}</data></node><edge source="a" target="b"/></graph></graphml>'
    files = [(0, named.format("old")), (1, named.format("new")), (2, None), (3, "<graphml><graph><node"), (4, ""), (5, "<graphml/>")]
    nodes, edges = store.graphml(spark.createDataFrame(files, "ord int, content string"), 3)
    assert nodes.select("id", "label", "line").collect() == [("a", "new", None)]
    assert edges.collect() == [("a", "b", None)]


def test_partitions_grow_with_the_rows(spark):
    assert spread(spark.range(1000).repartition(2), 100).rdd.getNumPartitions() == 10
    assert spread(spark.range(1000).repartition(2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert exports.task_count(spark, 100 * exports.TASK_SHARDS) == 100
    nodes, edges = _graph(spark)
    assert exports.graphml_documents(nodes, edges, shards=64 * exports.TASK_SHARDS).rdd.getNumPartitions() == 64
