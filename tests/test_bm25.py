"""BM25 of many queries: scored by document, without a shuffle of rows by query, term and document."""

from graphquarry.operators import retrieval as R

_DOCS = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, i % 9 + 1)) + " the lonely" * (i % 2)) for i in range(60)]
_ASKED = [(1, "w1 w2 w3 nothing"), (2, "w6 the w5 w6"), (3, "the"), (4, "lonely w0")]


def _scores(spark, **more):
    docs, terms = spark.createDataFrame(_DOCS, "doc_id bigint, text string"), R.query_terms(spark.createDataFrame(_ASKED, "query_id bigint, text string"))
    return R.bm25(terms, R.postings(docs, "doc_id", "text", **({"asked": terms} if more.pop("asked", False) else {})), R.doc_stats(docs, "doc_id", "text"), **more)


def _rows(df):
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in df.collect())


def test_rows_are_the_same_however_they_are_dealt(spark):
    whole = _rows(_scores(spark))
    assert whole and {q for q, _, _ in whole} == {1, 2, 4}
    assert _rows(_scores(spark, task_postings=3)) == whole
    assert _rows(_scores(spark, asked=True)) == whole


def test_scores_are_not_shuffled(spark):
    plan = _scores(spark, task_postings=10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(term" not in plan


def test_only_asked_terms_are_counted(spark):
    docs = spark.createDataFrame(_DOCS, "doc_id bigint, text string")
    asked = spark.createDataFrame([("w1",), ("w1",), ("gone",)], "term string")
    every = {(r.doc_id, r.term, r.tf) for r in R.postings(docs, "doc_id", "text").collect()}
    assert {(r.doc_id, r.term, r.tf) for r in R.postings(docs, "doc_id", "text", asked).collect()} == {r for r in every if r[1] == "w1"}
