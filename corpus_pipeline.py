"""The corpus pipeline: language ID, quality, near-duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, by one operator of
graphquarry.llm over all rows of docs.  All but the last return the columns of docs, whatever these are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import language, mixing, neardup, packing, quality
from graphquarry.llm.common import broadcast_within, cut, table

#: Texts with letters whose best language is less likely than this go, like those without letters.
LEAST_LANGUAGE_SCORE = 0.3


#: Bytes of a batch that goes to a Python worker; a stage's own session setting is kept if it isn't Spark's default.
BATCH_BYTES = 8 << 20


def _bounded(spark: SparkSession) -> None:
    """Smaller batches between the JVM and Python workers, since a task holds several, outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def _shielded(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """docs under column names of its own, these names, and the columns that give the old names back."""
    names = tuple(f"doc_column_{i}" for i in range(len(docs.columns)))
    return docs.toDF(*names), names, [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or letters, or too unlike every learned language, go."""
    _bounded(spark)
    own, names, back = _shielded(docs)
    at = dict(zip(docs.columns, names, strict=True))
    out = language.language_id(own, at["doc_id"], at["text"], at["lang"], keep=names)
    return out.filter((F.col("lang_pred") != language.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*back)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's cut."""
    _bounded(spark)
    own, names, back = _shielded(docs)
    at = dict(zip(docs.columns, names, strict=True))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(at["doc_id"]), F.col("quality").alias("quality"))
    out = quality.quality(own, labels, at["doc_id"], at["text"], keep=names)
    return out.filter(F.col("score") >= quality.CUT).select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id, once; rows without an id stay."""
    _bounded(spark)
    classes = cut(neardup.near_duplicates(docs).filter("doc_id is not null"))
    gone = cut(classes.filter("not kept").select("doc_id").distinct())
    repeated = cut(classes.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    left = docs.join(broadcast_within(gone, 200_000), "doc_id", "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return left
    again = broadcast_within(repeated, 200_000)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights, each as often as its leaf's epochs take it."""
    own, names, back = _shielded(docs)
    at = dict(zip(docs.columns, names, strict=True))
    return mixing.mix(own, at["doc_id"], at["text"], lang=F.col(at["lang"]), source=F.col(at["source"])).select(*back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document."""
    return packing.pack(docs, keep=("lang", "source"))


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL expresses the language, quality and near-duplicate stages; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
