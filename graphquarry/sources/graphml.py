"""Nodes and edges of GraphML documents: each document is parsed in the task that has it."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this module

#: GraphML keys of node columns.
KEYS = {"label": "labelV", "name": "NAME", "code": "CODE", "filename": "FILENAME", "line": "LINE_NUMBER"}
NODES = "ord int, id string, " + ", ".join(f"{c} string" for c in KEYS)
EDGES = "src string, dst string, label string"


def _graphs(content: str | None) -> Iterator[tuple[str, ElementTree.Element]]:
    """The name space, as tags have it, and the graphs of a document; none of one that is null or no XML."""
    try:
        root = ElementTree.fromstring(content) if content else None
    except ElementTree.ParseError:
        return
    if root is not None:
        space = root.tag[: root.tag.find("}") + 1]
        yield from ((space, g) for g in root.findall(f"{space}graph"))


def _nodes(content: str | None) -> Iterator[tuple]:
    for space, graph in _graphs(content):
        tag = f"{space}data"
        for node in graph.iterfind(f"{space}node"):
            facts = {d.get("key"): d.text for d in node if d.tag == tag}
            yield (node.get("id"), *[facts.get(k) for k in KEYS.values()])


def _edges(content: str | None) -> Iterator[tuple]:
    for space, graph in _graphs(content):
        tag = f"{space}data"
        for edge in graph.iterfind(f"{space}edge"):
            yield edge.get("source"), edge.get("target"), next((d.text for d in edge if d.tag == tag and d.get("key") == "labelE"), None)


def _columns(rows: Iterable[tuple], width: int) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [()] * width
    return [pa.array(c, pa.string()) for c in columns]


def nodes(files: DataFrame, once: bool = False) -> DataFrame:
    """NODES rows of documents (ord, content); with once a document gives an id's last row only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["ord", "id", *KEYS]
        for batch in batches:
            for at, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = _nodes(content.as_py())
                found = _columns({r[0]: r for r in rows}.values() if once else rows, len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()] * len(found[0]), pa.int32()), *found], names=names)

    return files.selectExpr("cast(ord as int) ord", "content").mapInArrow(run, NODES)


def edges(files: DataFrame, once: bool = False) -> DataFrame:
    """EDGES rows of documents (ord, content); with once a document gives no row twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = _edges(content.as_py())
                yield pa.RecordBatch.from_arrays(_columns(dict.fromkeys(rows) if once else rows, 3), names=["src", "dst", "label"])

    return files.select("content").mapInArrow(run, EDGES)
