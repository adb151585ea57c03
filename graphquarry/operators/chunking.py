"""Markdown sections as a plan, and size-bounded chunks as a fold over one document's sections."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema

HEADING = r"^(#{1,4})\s+(\S.*)$"


def sections(docs: DataFrame) -> DataFrame:
    """(doc, section, level, header, header_path, content, line_start, line_end, has_code) of (doc, text).

    A heading inside a code fence counts too; text before the first heading is dropped.  The lines of a document
    are numbered in it, so a section is a running count of headings; a header path takes the last heading of
    each higher level that no heading of a still higher level follows.
    """
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", F.when(F.col("line").rlike(HEADING), F.length(F.regexp_extract("line", HEADING, 1))))
    lines = lines.withColumn("header", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("line", HEADING, 2))))
    upto = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(upto))
    for k in range(1, 4):
        lines = lines.withColumn(f"at{k}", F.coalesce(F.max(F.when(F.col("level") == k, F.col("pos"))).over(upto), F.lit(-1)))
        lines = lines.withColumn(f"h{k}", F.last(F.when(F.col("level") == k, F.col("header")), ignorenulls=True).over(upto))
    above = {1: F.lit(-1), 2: F.col("at1"), 3: F.greatest("at1", "at2")}
    parents = [F.when((F.col("level") > k) & (F.col(f"at{k}") > above[k]), F.col(f"h{k}")) for k in range(1, 4)]
    lines = lines.withColumn("path", F.when(F.col("level").isNotNull(), F.concat_ws(" > ", *parents, "header"))).filter("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    out = lines.groupBy("doc", "section").agg(
        F.max("level").alias("level"),
        F.max("header").alias("header"),
        F.max("path").alias("header_path"),
        body.alias("body"),
        (F.min("pos") + 1).alias("line_start"),
        (F.max("pos") + 1).alias("line_end"),
        F.max(F.col("level").isNull() & F.ltrim("line").startswith("```")).alias("has_code"),
    )
    return out.select("doc", "section", "level", "header", "header_path", F.regexp_replace("body", r"^\s+|\s+$", "").alias("content"), "line_start", "line_end", "has_code")


def section_type(path: Column, has_code: Column) -> Column:
    low = F.lower(path)
    config = low.rlike(r"config|\.yaml|\.yml|\.json|\.toml|\.ini")
    return F.when(low.contains("readme"), "readme").when(config, "config").when(has_code, "code").otherwise("text")


def node_type(path: Column, has_code: Column) -> Column:
    """The type of a chunk's node: code comes first here."""
    return F.when(has_code, "code").otherwise(section_type(path, F.lit(False)))


@dataclass
class Chunk:
    content: str
    header: str
    level: int
    header_path: str
    line_start: int
    line_end: int
    has_code: bool
    chunk_id: str | None
    tokens: int


def _pieces(title: str, body: str, most: int, overlap: int) -> Iterator[str]:
    """Texts of at most about `most` characters: paragraphs are gathered under the title; one that is too long is
    sliced without overlap.  A full text is preceded by its own tail, which the next text begins with as well."""
    held, size = [title], len(title)
    for paragraph in body.split("\n\n"):
        need = len(paragraph) + 2
        if need > most:
            if held:
                yield "".join(held).strip()
            step = most - len(title) if most > len(title) else most
            for at in range(0, len(paragraph), step):
                yield (title + paragraph[at : at + step]).strip()
            held, size = [title], len(title)
            continue
        if held and size + need > most:
            text = "".join(held).strip()
            lead = f"{text[-overlap:]}\n\n...\n\n" if overlap and text else ""
            yield lead + text
            held = [title, lead] if lead else [title]
            size = len(title) + len(lead)
        held.append(paragraph + "\n\n")
        size += need
    if held:
        yield "".join(held).strip()


def _joined(a: Chunk, b: Chunk) -> Chunk:
    content = f"{a.content}\n\n{b.content}"
    return replace(a, content=content, line_end=b.line_end, has_code=a.has_code or b.has_code, tokens=len(content.split()))


def chunk_sections(rows: Iterable[dict], most: int = schema.MAX_CHARS, overlap_tokens: int = schema.OVERLAP_TOKENS, least: int = schema.MIN_CHUNK) -> list[Chunk]:
    """Chunks of one document's sections in order; small ones go into the next, the last small ones into the one before."""
    if most <= 0:
        raise ValueError("the chunk size must be positive")
    chunks = []
    for r in rows:
        title = f"{'#' * r['level']} {r['header']}\n\n"
        whole = title + r["content"]
        base = Chunk(whole, r["header"], r["level"], r["header_path"], r["line_start"], r["line_end"], r["has_code"], None, len(whole.split()))
        if len(whole) <= most:
            chunks.append(base)
            continue
        texts = list(_pieces(title, r["content"], most, overlap_tokens * 4))
        for i, t in enumerate(texts):
            last_alone = len(texts) == 1
            chunks.append(replace(base, content=t, tokens=int(len(t) / 3.5), header=base.header if last_alone else f"{base.header} (part {i + 1})", chunk_id=None if last_alone else f"{base.header}_{i}"))
    out: list[Chunk] = []
    small: Chunk | None = None
    for c in chunks:
        if len(c.content) < least:
            small = c if small is None else _joined(small, c)
        else:
            out.append(c if small is None else _joined(small, c))
            small = None
    if small is not None:
        out = [*out[:-1], _joined(out[-1], small)] if out else [small]
    return out


CHUNKS = "doc string, n int, content string, header string, header_depth int, header_path string, line_start int, line_end int, has_code boolean, chunk_id string, token_count int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_CHUNKS = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in CHUNKS.split(", ")])
#: What \s is to Spark's patterns, and the line ends that $ may stand before.
_SPACE, _ENDS = " \t\n\x0b\f\r", "\x85\u2028\u2029"


def headings(docs: DataFrame) -> DataFrame:
    """(doc, text, at, level, header) of (doc, text): the lines that are headings, what number of line, level and text each has.

    Texts without any stay as rows, with a null for the text: a filter would be pushed to where the text is made, below what deals texts out.
    """
    part = lambda x, i: F.regexp_extract(x, HEADING, i)
    found = F.transform(F.split("text", "\n"), lambda x, i: F.when(x.startswith("#") & x.rlike(HEADING), F.struct(i.alias("at"), F.length(part(x, 1)).alias("level"), F.trim(part(x, 2)).alias("header"))))
    heads = docs.select("doc", "text", F.filter(found, lambda h: h.isNotNull()).alias("h"))
    return heads.select("doc", F.when(F.size("h") > 0, F.col("text")).alias("text"), *[F.col(f"h.{c}").alias(c) for c in ("at", "level", "header")])


def _body(lines: list[str]) -> str:
    """Lines without the white space around them, as sections() trims it."""
    text = "\n".join(lines).lstrip(_SPACE)
    return text[:-1].rstrip(_SPACE) + text[-1] if text and text[-1] in _ENDS else text.rstrip(_SPACE)


def document_sections(text: str, at: list[int], level: list[int], header: list[str]) -> Iterator[dict]:
    """The rows of sections() for one document of headings()."""
    lines = text.split("\n")
    last: dict[int, tuple[int, str]] = {}
    for pos, end, depth, name in zip(at, [*at[1:], len(lines)], level, header, strict=True):
        last[depth] = (pos, name)
        above, path = -1, []
        for k in range(1, depth):
            if k in last and last[k][0] > above:
                path.append(last[k][1])
                above = last[k][0]
        body = lines[pos + 1 : end]
        yield {"level": depth, "header": name, "header_path": " > ".join([*path, name]), "content": _body(body), "line_start": pos + 1, "line_end": end, "has_code": any(x.lstrip(" ").startswith("```") for x in body)}


def chunks(docs: DataFrame, most: int = schema.MAX_CHARS, overlap_tokens: int = schema.OVERLAP_TOKENS, least: int = schema.MIN_CHUNK) -> DataFrame:
    """CHUNKS rows of (doc, text).  Documents are dealt whole and once; the fold runs over one document's sections at a time."""
    # a document's lines stay in its row: dealt as rows of their own they cost a sort and a window of all lines
    dealt = docs.select(F.col("doc").cast("string").alias("doc"), "text").repartition("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts[0] is None:
                    continue
                for n, c in enumerate(chunk_sections(document_sections(*parts), most, overlap_tokens, least)):
                    rows.append((doc, n, c.content, c.header, c.level, c.header_path, c.line_start, c.line_end, c.has_code, c.chunk_id, c.tokens))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows) if rows else [[]] * len(_CHUNKS), _CHUNKS, strict=True)], schema=_CHUNKS)

    return headings(dealt).mapInArrow(run, CHUNKS)


def slices(docs: DataFrame, width: int) -> DataFrame:
    """(doc, n, piece): fixed-width slices without overlap."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(width))
    at = docs.select("doc", "text", F.posexplode(starts).alias("n", "start"))
    return at.select("doc", "n", F.substr("text", F.col("start") + 1, F.lit(width)).alias("piece")).filter("piece <> ''")


def code_blocks(docs: DataFrame) -> DataFrame:
    """(doc, n, lang, code): fenced blocks, language 'text' if none is named."""
    pattern = F.lit(r"(?s)```(\w+)?\n(.*?)\n```")
    both = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("lang"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("code"))
    out = docs.select("doc", F.posexplode(both).alias("n", "b"))
    return out.select("doc", "n", F.coalesce(F.nullif("b.lang", F.lit("")), F.lit("text")).alias("lang"), F.regexp_replace("b.code", r"^\s+|\s+$", "").alias("code"))


def nodes_from_chunks(rows: DataFrame, path: Column) -> DataFrame:
    """Chunks as nodes: a deterministic id from path, content hash and order."""
    h, p = F.sha1("content"), F.ltrim(path, F.lit("/"))
    return rows.select(F.sha1(F.concat_ws("|", p, h, F.col("n").cast("string"))).alias("node_id"), h.alias("hash"), F.col("header").alias("title"), "content", p.alias("path"), node_type(p, F.col("has_code")).alias("type"), "token_count")
