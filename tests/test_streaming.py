"""Claims resolved batch by batch equal claims resolved at once, where they arrive in order."""

from graphquarry.operators import claims as C
from graphquarry.streaming import claims as S


def test_streamed_claims(spark, tmp_path):
    rows = [(i, "Acme" if i % 3 else "Beta", "CEO", float(i % 4), f"2024-01-{1 + i // 6:02d}") for i in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], S.STATE).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
        stream = spark.readStream.schema(S.STATE).parquet(str(tmp_path / "in" / "*"))
        S.resolve_stream(stream, str(tmp_path / "out")).awaitTermination()
    key = lambda df: sorted((r.source, r.target, r.type) for r in df.collect())
    assert key(S.edges(spark, str(tmp_path / "out"))) == key(C.temporal_edges(spark.createDataFrame(rows, S.STATE)))


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    a = spark.createDataFrame([(1, "A", "x", 1.0, "2024-01-01"), (2, "A", "x", 2.0, "2024-01-02")], S.STATE)
    b = spark.createDataFrame([(3, "A", "x", 2.0, "2024-01-03")], S.STATE)
    for epoch, batch in ((0, a), (1, b), (1, b)):
        S.resolve_batch(batch, epoch, str(tmp_path))
    assert sorted((r.source, r.target, r.type) for r in S.edges(spark, str(tmp_path)).collect()) == [(2, 1, "contradicts"), (2, 1, "supersedes"), (3, 2, "supersedes")]
