"""Source files: reading, filtering, classification, wrapping."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, content) of all files under a path.  UTF-8, else Latin-1, as the bytes allow."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.col("length").alias("bytes"), text.alias("content"))


def source_type(path: Column, keys: Column) -> Column:
    """repository, conversation, markdown or directory, from a path and the top-level keys of a JSON file."""
    low, name = F.lower(path), T.file_name(path)
    chat = F.arrays_overlap(keys, T.strings(["messages", "entries", "chat_messages", "sessionId"])) | name.contains("conversation") | name.contains("chat")
    return (
        F.when(low.rlike(r"github\.com|gitlab\.com|bitbucket\.org"), "repository")
        .when(low.endswith(".aichat") | (low.endswith(".txt") & path.contains("antigravity")) | (low.endswith(".json") & F.coalesce(chat, F.lit(False))), "conversation")
        .when(low.endswith(".md"), "markdown")
        .when(low.rlike(r"https?://|git@"), "repository")
        .otherwise("directory")
    )


def project_root(start: str) -> str:
    """The nearest folder from `start` upwards that is a repository, else the nearest with a project's marker, else `start`."""
    at = Path(start).resolve()
    folders = [at, *at.parents]
    for markers in ([".git"], words.PROJECT_MARKERS):
        for folder in folders:
            if any((folder / m).exists() for m in markers):
                return str(folder)
    return str(at)


def kept(path: Column, size: Column) -> Column:
    """Whether the file filter keeps a file.  Patterns are substrings of the whole path."""
    extension = F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1)
    # a filter is pushed to where the path is made, and would make it anew for each pattern
    skipped = F.exists(F.array(path), lambda p: T.any_in(p, words.SKIP_PATTERNS))
    return ~skipped & ~extension.isin(words.SKIP_EXTENSIONS) & size.between(1, words.MAX_FILE_SIZE)


def language(path: Column) -> Column:
    """The programming language by extension; null outside code and in excluded folders (by whole path component)."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    excluded = F.arrays_overlap(F.split(path, "/"), T.strings(words.EXCLUDED_FOLDERS))
    known = F.create_map(*[F.lit(x) for kv in words.LANGUAGES.items() for x in kv])
    return F.when(~excluded, known[extension])


def code_lines(content: Column) -> Column:
    return F.size(F.filter(F.split(content, "\n"), lambda x: F.trim(x) != ""))


def worth_analysing(files: DataFrame) -> DataFrame:
    """One row: files, lines, and whether they are enough for a code-property graph."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("lines").cast("bigint").alias("lines")).withColumn("worth", (F.col("files") >= words.MIN_CODE_FILES) & (F.col("lines") >= words.MIN_CODE_LINES))


def wrapped(path: Column, lang: Column, content: Column) -> Column:
    """A file as markdown: its path as heading and its text in a fence."""
    return F.concat(F.lit("# "), path, F.lit("\n\n```"), F.coalesce(lang, F.lit("")), F.lit("\n"), content, F.lit("\n```\n"))
