"""What a store's update plans: texts dealt whole, lines kept in their rows, symbols looked up once, lookups that can give nothing left out."""

from graphquarry.operators import chunking as K
from graphquarry.operators import edges as E
from graphquarry.plans import index
from graphquarry.queries import stores
from graphquarry.queries.registry import sql

_ODD = [
    "# a\n## b\n### c\n#### d\ntext\n## e\n#### f\n# g\n### h\n#### i",
    "before\n#no heading\n##  two  \n \t\n```\nx\n```\n  ```late\n\n",
    "# only", "", "no heading", None, "# x\n \n\t\r\n", "# s\nbody   ", "# s\n   ", "# s\nbody \x85", "# s\r\nbody\r\n## t\r\nmore \r\n", "#  nb\nx \n", "##### five\n# one\n\n# one\n",
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_document_sections_are_those_of_the_plan(spark):
    docs = spark.createDataFrame(list(enumerate(_ODD)), "doc int, text string")
    want = _rows(K.sections(docs).select("doc", "level", "header", "header_path", "content", "line_start", "line_end", "has_code"))
    heads = [h for h in K.headings(docs).collect() if h.text is not None]
    got = [(h.doc, *s.values()) for h in heads for s in K.document_sections(h.text, h.at, h.level, h.header)]
    assert len(want) > 15 and sorted(got, key=repr) == want
    assert K.chunks(docs, least=0).count() == len(want)


def test_lines_stay_in_their_rows(spark):
    plan = _plan(K.chunks(spark.createDataFrame([("a", "# x\ny")], "doc string, text string")))
    assert "Window" not in plan and "Generate" not in plan and "Sort" not in plan
    files = spark.createDataFrame([("a.md", 5, "# x\ny")], "path string, bytes long, content string").repartition(3)
    below = _plan(index.build_nodes(files)).split("RoundRobinPartitioning")[-1]
    assert "regexp_replace" not in below and "split" not in below  # texts are not made ready before they are dealt out


def test_parts_are_dealt_before_they_become_files(spark, sf_dir):
    assert "RoundRobinPartitioning" in _plan(sql(spark, sf_dir, stores._SOURCE, dealt=True))


def test_symbol_edges_of_both_types_are_found_together(spark):
    rows = [("a", "load", "definition"), ("b", "load", "call"), ("b", "load", "reference"), ("c", "load", "import"), ("c", "save", "definition"), ("a", "save", "call"), ("d", "save", "reference"), ("c", "save", "call"), ("c", "save", "definition")]
    symbols = spark.createDataFrame(rows, "node_id string, name string, kind string")
    every = {("b", "a", "reference"), ("b", "a", "call"), ("c", "a", "reference"), ("a", "c", "reference"), ("a", "c", "call"), ("d", "c", "reference")}
    found = index.symbol_edges(symbols)
    assert _plan(found).count("Join") == 1
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(every)
    for near in ("a", "d"):
        touching = spark.createDataFrame([(near,), (near,)], "node_id string")
        assert sorted(tuple(r)[:3] for r in index.symbol_edges(symbols, touching=touching).collect()) == sorted(e for e in every if near in e[:2])


def test_short_lists_are_looked_up_by_names_alone(spark):
    names = lambda size: spark.createDataFrame([(i, f"n{i // 2}_{k}") for i in range(20) for k in range(size)], "node_id int, name string")
    few, many = E.jaccard_edges(names(2)), E.jaccard_edges(names(14))
    assert _plan(few).count("Join") == 1 < _plan(many).count("Join")
    assert all({(r.source, r.target, r.score) for r in df.collect()} == {(i, i + 1, 1.0) for i in range(0, 20, 2)} for df in (few, many))
