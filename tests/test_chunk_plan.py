"""Chunks: lines are dealt by document once, whatever the type of its id."""

from graphquarry.operators import chunking as K

_TEXTS = [(i, "# top\none\n\n## sub\n" + "word " * (40 * i) + "\n```\nx = 1\n```\n# last\n" + "tail " * i) for i in range(12)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_once(spark):
    numbers, texts = (spark.createDataFrame(_TEXTS, "doc bigint, text string"), spark.createDataFrame([(str(i), t) for i, t in _TEXTS], "doc string, text string"))
    a, b = K.chunks(numbers, 200, 5, 30), K.chunks(texts, 200, 5, 30)
    assert [_plan(x).count("Exchange hashpartitioning") for x in (a, b)] == [1, 1]
    assert sorted(a.collect()) == sorted(b.collect())
