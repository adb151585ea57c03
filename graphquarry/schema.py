"""Constants and dimension tables of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = (
    "node_id STRING, hash STRING, title STRING, content STRING, path STRING, type STRING, token_count INT, created_at BIGINT, "
    "header_depth INT, header_path STRING, chunk_id STRING, line_start INT, line_end INT, "
    "entities ARRAY<STRUCT<name: STRING, type: STRING, description: STRING>>, metadata MAP<STRING, STRING>"
)
EDGES = "source STRING, target STRING, type STRING, score DOUBLE, created_at BIGINT, metadata MAP<STRING, STRING>, ord BIGINT"
CPG_NODES = "id STRING, label STRING, name STRING, code STRING, filename STRING, line INT, idx INT, type_full_name STRING"
CPG_EDGES = "src STRING, dst STRING, label STRING"

# Fixed values of the data model.
TOP_K, MAX_HOPS, NODE_CAP = 20, 4, 300
ALPHA, BETA, GAMMA = 0.6, 0.3, 0.1
CENTRALITY_WEIGHTS = {"betweenness": 0.5, "degree": 0.2, "closeness": 0.2, "eigenvector": 0.1}
ROLE_WEIGHTS = {"code": 0.9, "conversation": 0.85, "tagged_snippet": 0.85, "config": 0.8, "readme": 0.7, "text": 0.6}
DEFAULT_ROLE_WEIGHT = 0.5
EDGE_TYPES = ("semantic", "reference", "hierarchy", "call", "data_flow", "control_flow", "ast", "conversation_references_code", "supersedes", "contradicts", "grounded")
DIRECTED_TYPES = ("reference", "call", "data_flow", "hierarchy", "control_flow")
UNTRAVERSED_TYPES = ("supersedes", "contradicts")
BM25_K1, BM25_B = 1.5, 0.75
DENSE_WEIGHT = 0.3
MAX_CHARS, OVERLAP_TOKENS, MIN_CHUNK = 20_000, 100, 150
PACK_TOKENS = 32_000
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}


def dimension(spark: SparkSession, values: dict[str, float], key: str, value: str) -> DataFrame:
    """A small table of fixed values; its size is that of the literal."""
    return spark.createDataFrame(list(values.items()), f"{key} string, {value} double")
