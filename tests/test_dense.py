"""Exact nearest vectors against all pairs, and vectors without a cosine."""

import math
import random

from graphquarry.operators import dense, retrieval
from pyspark.sql import functions as F

FORM = "doc_id bigint, embedding array<float>"


def _asked(vectors):
    return vectors.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, "nan" if r.score is not None and math.isnan(r.score) else r.score) for r in df.collect())


def test_best_equals_all_pairs(spark):
    random.seed(3)
    hot = [[random.gauss(0, 1) for _ in range(8)] for _ in range(3)]
    rows = [(i, hot[i % 3] if i % 4 else [random.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows = [(i, [2 * x for x in v] if i % 7 == 0 else v) for i, v in rows]
    v = spark.createDataFrame(rows, FORM).repartition(3)
    want = _rows(retrieval.top_k(retrieval.dense_scores(_asked(v), v), 6))
    assert _rows(retrieval.top_k(dense.best(_asked(v), v, 6, tile=16, block=7), 6)) == want
    assert _rows(retrieval.top_k(dense.best(_asked(v), v, 6), 6)) == want


def test_a_task_gives_k_rows_a_query(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(300)], FORM).repartition(4)
    assert dense.best(_asked(v), v, 2, tile=8).groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0] == 2


def test_vectors_without_a_cosine(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (10, None), (15, [None, 1.0])]
    got = _rows(retrieval.top_k(dense.best(_asked(v := spark.createDataFrame(rows, FORM)), v, 8), 8))
    assert [x[2:] for x in got if x[0] == 0] == [(1, "nan"), (4, "nan"), (5, "nan"), (0, 1.0), (3, 0.707107), (2, None), (10, None), (15, None)]
    assert [x[2:] for x in got if x[0] == 5] == [(i, "nan") for i in (0, 1, 3, 4, 5)] + [(i, None) for i in (2, 10, 15)]
    assert [x[2:] for x in got if x[0] == 10] == [(i, None) for i in (0, 1, 2, 3, 4, 5, 10, 15)]


def test_places_round_half_up():
    import numpy as np

    assert dense.places(np.array([0.1234565, -0.1234565, 0.1234564999, 0.0])).tolist() == [123457.0, -123457.0, 123456.0, 0.0]
