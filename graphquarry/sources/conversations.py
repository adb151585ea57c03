"""Conversation logs of several editors as one table of turns: (path, conv_id, title, turn, role, text, at, source).

Each reader takes (path, content) rows, as sources.files.read_texts gives them, and parses in the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_MESSAGE = "STRUCT<role: STRING, sender: STRING, content: STRING, text: STRING, value: STRING, timestamp: STRING, created_at: STRING>"
_LOG = f"id STRING, uuid STRING, sessionId STRING, title STRING, name STRING, messages ARRAY<{_MESSAGE}>, entries ARRAY<{_MESSAGE}>, chat_messages ARRAY<{_MESSAGE}>"
COLUMNS = ("path", "conv_id", "title", "turn", "role", "text", "at", "source")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def log_format(path: Column, content: Column) -> Column:
    """antigravity, cursor, claude or github_copilot; null for anything else."""
    keys = F.coalesce(F.json_object_keys(F.when(path.endswith(".json"), content)), T.strings([]))
    has = lambda *k: F.arrays_overlap(keys, T.strings(k))
    first = F.coalesce(F.json_object_keys(F.get_json_object(content, "$.messages[0]")), T.strings([]))
    return (
        F.when(path.rlike(r"\.(txt|md)$") & path.contains("antigravity"), "antigravity")
        .when(path.endswith(".aichat"), "cursor")
        .when(has("chat_messages", "uuid"), "claude")
        .when(has("sessionId", "messages") & F.arrays_overlap(first, T.strings(["role", "sender"])), "github_copilot")
        .when(has("entries") | path.endswith("/entries.json"), "github_copilot")
    )


def _turns(parsed: DataFrame, messages: Column, conv: Column, title: Column, role: Column, text: Column, at: Column, source: str) -> DataFrame:
    rows = parsed.select("path", conv.alias("conv_id"), title.alias("title"), F.posexplode(messages).alias("turn", "m"))
    return rows.select("path", "conv_id", "title", "turn", role.alias("role"), F.coalesce(text, F.lit("")).alias("text"), at.alias("at"), F.lit(source).alias("source"))


def antigravity(files: DataFrame) -> DataFrame:
    """User requests in tags; without any, texts after User:, Human: or Prompt:; without these, a file of 11 to 49999
    characters as one request."""
    tagged = F.regexp_extract_all("content", F.lit(r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>"), F.lit(1))
    said = F.regexp_extract_all("content", F.lit(r"(?is)(?:User|Human|Prompt):\s*(.*?)(?=\n(?:User|Human|Prompt|Assistant|Model|System):|$)"), F.lit(1))
    whole = F.when(F.length("content").between(11, 49_999), F.array("content")).otherwise(T.strings([]))
    clean = lambda a: F.transform(a, lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    found = F.when(F.size(tagged) > 0, clean(tagged)).when(F.size(said) > 0, F.filter(clean(said), lambda s: s != "")).otherwise(clean(whole))
    parts = F.split("path", "/")
    brain = F.array_position(parts, "brain").cast("int")
    conv = F.when(brain > 0, F.get(parts, brain)).otherwise(F.get(parts, F.size(parts) - 2))
    title = F.initcap(F.replace(stem(F.col("path")), F.lit("_"), F.lit(" ")))
    rows = files.select("path", conv.alias("conv_id"), title.alias("title"), F.posexplode(found).alias("turn", "text"))
    return rows.withColumns({"role": F.lit("user"), "at": F.lit(None).cast("string"), "source": F.lit("antigravity")}).select(*COLUMNS)


def _parsed(files: DataFrame) -> DataFrame:
    return files.select("path", F.from_json("content", _LOG).alias("d"))


def cursor(files: DataFrame) -> DataFrame:
    name = stem(F.col("path"))
    return _turns(_parsed(files), F.col("d.messages"), F.coalesce("d.id", name), F.coalesce("d.title", name), F.coalesce("m.role", F.lit("user")), F.col("m.content"), F.col("m.timestamp"), "cursor")


def claude(files: DataFrame) -> DataFrame:
    name = stem(F.col("path"))
    role = F.when(F.col("m.sender") == "assistant", "assistant").otherwise("user")
    return _turns(_parsed(files), F.col("d.chat_messages"), F.coalesce("d.uuid", name), F.coalesce("d.name", name), role, F.col("m.text"), F.col("m.created_at"), "claude")


def copilot(files: DataFrame) -> DataFrame:
    name = stem(F.col("path"))
    role = F.when((F.col("m.role") == "assistant") | (F.col("m.sender") == "copilot"), "assistant").otherwise("user")
    return _turns(_parsed(files), F.coalesce("d.messages", "d.entries"), F.coalesce("d.id", "d.sessionId", name), F.coalesce("d.title", "d.name", name), role, F.coalesce("m.content", "m.text", "m.value"), F.coalesce("m.timestamp", "m.created_at"), "github_copilot")


READERS = {"antigravity": antigravity, "cursor": cursor, "claude": claude, "github_copilot": copilot}


def conversations(files: DataFrame) -> DataFrame:
    """Turns of all files of a known format."""
    marked = files.withColumn("format", log_format(F.col("path"), F.col("content")))
    return reduce(DataFrame.unionByName, [read(marked.filter(F.col("format") == k).drop("format")) for k, read in READERS.items()])


def ingest(files: DataFrame, path: str) -> None:
    """Write each conversation of the files as markdown, in a folder of its own under `path`."""
    as_markdown(conversations(files)).select(F.regexp_replace("conv_id", r"[^\w.-]", "_").alias("conversation"), F.col("text").alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy("conversation").text(path)


def as_markdown(turns: DataFrame) -> DataFrame:
    """(conv_id, text): a heading, facts, and the messages in order; times are those of the turns or --:--:--."""
    icon = F.when(F.col("role") == "user", "👤").when(F.col("role") == "assistant", "🤖").otherwise("⚙️")
    time = F.coalesce(F.date_format(F.try_to_timestamp("at"), "HH:mm:ss"), F.lit("--:--:--"))
    message = F.concat(F.lit("## Message "), (F.col("turn") + 1).cast("string"), F.lit(" - "), icon, F.lit(" "), F.initcap("role"), F.lit(" ("), time, F.lit(")\n\n"), "text", F.lit("\n"))
    grouped = turns.groupBy("conv_id", "title", "source").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"))
    head = F.concat(F.lit("# Conversation: "), "title", F.lit("\n\n**ID**: "), F.col("conv_id").cast("string"), F.lit("\n**Messages**: "), F.size("l").cast("string"), F.lit("\n**Source**: "), "source", F.lit("\n\n---\n\n"))
    return grouped.select("conv_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["m"]), "\n")).alias("text"))
