"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, fingerprint, language, licenses, lm, media, mixing, neardup, negatives, packing, quality, triejoin
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best, names = F.get("matches", 0), F.array_sort(F.array_distinct("matches.license"))
    return found.select(
        "doc_id",
        "n_lines",
        best["license"].alias("license"),
        F.round(best["dice"], 6).alias("dice"),
        best["piece"].alias("piece"),
        best["position"].alias("position"),
        F.size(names).alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
    )


ORACLES["op1_license_scan"] = licenses.oracle_sql()


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "mix_domain", "lang", "source", "mix_epoch")


ORACLES["op4_mixing"] = mixing.oracle_sql()


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


ORACLES["op6_packing"] = packing.oracle_sql()


@query
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    return out.withColumn("n_pairs", F.size("pairs").cast("long"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


ORACLES["op8_chat_format"] = chat.ORACLE


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.language_id(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op12_hard_negatives"] = negatives.ORACLE


@query
def op13_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.trie_join(table(spark, sf_dir, "documents"))
