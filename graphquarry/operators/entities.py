"""Entities of code by its syntax tree, entity lists merged, tagged snippets, and rows as JSON."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T

ENTITY = "name string, type string, description string"

# Patterns of definitions in other languages, for text that is no Python.
TYPE_PATTERNS = [
    r"(?:class|interface|type|struct)\s+(\w+)",
    r"type\s+(\w+)\s+struct",
    r"export\s+(?:default\s+)?(?:class|interface|type)\s+(\w+)",
]
FUNCTION_PATTERNS = [
    r"(?:def|function|func)\s+(\w+)",
    r"func\s+\((?:[^)]+)\)\s+(\w+)",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|_)\s*=>",
    r"(?:const|let|var)\s+(\w+)\s*=\s*function",
    r"(?:public|private|protected|static|async)\s+(?:[\w\[\]<>]+\s+)?(\w+)\s*\(",
]
NO_FUNCTIONS = ("if", "for", "while", "switch", "catch")

Entity = tuple[str, str, str]


def _imported(node: ast.Import | ast.ImportFrom) -> Iterator[Entity]:
    module = getattr(node, "module", None)
    for alias in node.names:
        yield alias.asname or alias.name, "reference", f"Imported from {module}" if module else f"Import: {alias.name}"


def _assigned(node: ast.Assign) -> Iterator[Entity]:
    for target in node.targets:
        if isinstance(target, ast.Name):
            yield target.id, "definition", f"Variable definition: {target.id}"


def _called(node: ast.Call) -> Iterator[Entity]:
    name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
    if name:
        yield name, "reference", f"Code call to {name}"


#: What each kind of syntax node gives; other kinds, asynchronous functions among them, give nothing.
FROM_SYNTAX = {
    ast.ClassDef: lambda n: [(n.name, "definition", f"Class definition: {n.name}")],
    ast.FunctionDef: lambda n: [(n.name, "definition", f"Function definition: {n.name}")],
    ast.Import: _imported,
    ast.ImportFrom: _imported,
    ast.Assign: _assigned,
    ast.Call: _called,
}


def code_entities(text: str | None) -> list[Entity]:
    """Entities of the text's fenced blocks, or of the whole; by patterns where it does not parse."""
    blocks = re.findall(r"```(?:\w+)?\n(.*?)\n```", text or "", re.S)
    code = "\n".join(blocks) or (text or "")
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        types = [(n, "definition", f"Extracted type: {n}") for p in TYPE_PATTERNS for n in re.findall(p, code)]
        return types + [(n, "definition", f"Extracted function: {n}") for p in FUNCTION_PATTERNS for n in re.findall(p, code) if n not in NO_FUNCTIONS]
    return [e for node in ast.walk(tree) if type(node) in FROM_SYNTAX for e in FROM_SYNTAX[type(node)](node)]


def entities_of(nodes: DataFrame) -> DataFrame:
    """(node_id, pos, name, type, description) of (node_id, content); texts go to Python in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([(c, pa.int32() if c == "pos" else pa.string()) for c in ("node_id", "pos", "name", "type", "description")])
        for batch in batches:
            rows = [(i, pos, *e) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for pos, e in enumerate(code_entities(text))]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(out), out, strict=True)], schema=out)

    return nodes.select(F.col("node_id").cast("string").alias("node_id"), "content").mapInArrow(run, f"node_id string, pos int, {ENTITY}")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, name, type, description): the union of two entity tables (node_id, pos, name, type, description), the
    first of each name and type of a node, old ones first."""
    both = old.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1)))
    return both.groupBy("node_id", "name", "type").agg(F.min_by("description", F.struct("origin", "pos")).alias("description"))


def snippets(rows: DataFrame) -> DataFrame:
    """Nodes of tagged snippets (tag, content, conv_id, question, at)."""
    tokens = T.code_tokens(F.col("tag"))
    meta = F.create_map(F.lit("tag"), F.col("tag"), F.lit("tag_tokens"), F.array_join(F.array_sort(tokens), " "), F.lit("conversation_id"), F.col("conv_id").cast("string"), F.lit("user_question"), F.col("question"))
    h = F.sha1("content")
    path = F.concat(F.lit("tagged_snippets/"), "tag", F.lit(".md"))
    return rows.select(F.sha1(F.concat_ws("|", path, h)).alias("node_id"), h.alias("hash"), F.col("tag").alias("title"), "content", path.alias("path"), F.lit("tagged_snippet").alias("type"), T.whitespace_tokens(F.col("content")).alias("token_count"), F.col("at").alias("created_at"), meta.alias("metadata"))


def to_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def edges_from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", schema.EDGES, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def prompt(system: str, query: Column, context: Column, identifiers: Column, explanation: Column, most: int = 10_000) -> Column:
    """The text for a language model: instructions, context, question, known identifiers, an explanation cut at `most`."""
    known = F.array_sort(F.array_distinct(F.filter(identifiers, lambda x: x != "")))
    cut = F.when(F.length(explanation) > most, F.concat(F.left(explanation, F.lit(most)), F.lit("\n[truncated]"))).otherwise(explanation)
    return F.concat(
        F.lit(f"{system}\n\nContext:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"),
        F.when(F.size(known) > 0, F.concat(F.lit("\n\nKNOWN_IDENTIFIERS (you may only reference these):\n"), F.array_join(known, ", "))).otherwise(""),
        F.when(F.coalesce(cut, F.lit("")) != "", F.concat(F.lit("\n\nExplanation Data:\n"), cut)).otherwise(""),
    )
