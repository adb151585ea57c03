"""Code-property graphs as GraphML documents, GraphSON lines and Neo4j CSV files, written and read back.

Rows go to shards by a hash of their node, so that a GraphML document holds a bounded number of nodes and their outgoing edges, and ids are those
of the tables.  The other two forms are a row a line.  Values may hold any text; nulls and empty strings stay apart but in GraphML,
where a property that is null or empty is left out.  All files are written through gzip, since tags and field names repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import store
from .graphml import KEYS

#: Nodes of a GraphML document, about.
SHARD_NODES = 2000
#: Documents that a task makes or reads, about.
TASK_SHARDS = 32
#: Codec of the files; each is what one task writes, so none is too large to be read in one piece.
CODEC = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def escaped(c: Column) -> Column:
    """Text for XML; line ends as references, since parsers change them."""
    for char, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(char), F.lit(to))
    return c


def shard_count(nodes: DataFrame, shard_nodes: int = SHARD_NODES) -> int:
    return max(1, -(-nodes.count() // shard_nodes))


def task_count(spark: SparkSession, shards: int) -> int:
    """Partitions for that many documents: they grow in number, not in size."""
    return min(shards, max(spark.sparkContext.defaultParallelism, -(-shards // TASK_SHARDS)))


def graphml_documents(nodes: DataFrame, edges: DataFrame, shard_nodes: int = SHARD_NODES, shards: int | None = None) -> DataFrame:
    """(ord, content): GraphML documents of about shard_nodes nodes each, with the edges that begin at them; `shards` if their number is known."""
    shards = shards or shard_count(nodes, shard_nodes)
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    data = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f'<data key="{key}">'), escaped(F.col(c).cast("string")), F.lit("</data>"))).otherwise("") for c, key in KEYS.items()]
    node = F.concat(F.lit('<node id="'), escaped(F.col("id")), F.lit('">'), *data, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), escaped(F.col("src")), F.lit('" target="'), escaped(F.col("dst")), F.lit('"><data key="labelE">'), escaped(F.col("label")), F.lit("</data></edge>"))
    lines = nodes.select(shard("id").alias("ord"), F.lit(0).alias("k"), node.alias("line")).unionByName(edges.select(shard("src").alias("ord"), F.lit(1).alias("k"), edge.alias("line")))
    body = lines.repartition(task_count(nodes.sparkSession, shards), "ord").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    return body.select("ord", F.concat(F.lit('<graphml><graph edgedefault="directed">'), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("</graph></graphml>")).alias("content"))


def write(nodes: DataFrame, edges: DataFrame, path: str, form: str) -> None:
    """Write a graph (schema.CPG_NODES, schema.CPG_EDGES) under path as graphml, graphson or neo4jcsv."""
    if form == "graphml":
        graphml_documents(nodes, edges).select(F.col("ord").alias("shard"), F.col("content").alias("value")).write.mode("overwrite").options(**CODEC).option("lineSep", "\n").partitionBy("shard").text(f"{path}/graphml")
    elif form == "graphson":
        own = [F.col(c) for c in nodes.columns if c not in ("id", "label")]
        nodes.select("id", "label", F.struct(*own).alias("properties")).write.mode("overwrite").options(**CODEC).option("ignoreNullFields", "true").json(f"{path}/graphson/vertices")
        edges.select(F.col("src").alias("outV"), F.col("dst").alias("inV"), "label").write.mode("overwrite").options(**CODEC).json(f"{path}/graphson/edges")
    elif form == "neo4jcsv":
        # a null is an empty field, an empty string a quoted one; line ends and backslashes in values are escaped, so that a row is a line
        plain = lambda df: df.select(*[F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        heads = {"id": ":ID", "label": ":LABEL", "line": "line:int", "idx": "idx:int", "src": ":START_ID", "dst": ":END_ID"}
        for name, df, own in (("nodes", nodes, heads), ("edges", edges, heads | {"label": ":TYPE"})):
            out = plain(df).withColumnsRenamed({c: own[c] for c in df.columns if c in own}).withColumn("part", F.col("label") if "label" not in own else F.col(own["label"]))
            out.write.mode("overwrite").options(**CODEC).option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").partitionBy("part").csv(f"{path}/neo4jcsv/{name}")
    else:
        raise ValueError(f"no export form is called {form}")


def _unplain(df: DataFrame) -> DataFrame:
    mark = "\u0001"  # stands for an escaped backslash while the others are taken back
    back = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("\\\\"), F.lit(mark)), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit(mark), F.lit("\\"))
    return df.select(*[back(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def read(spark: SparkSession, path: str, form: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of an export; GraphML has the columns of store.graphml, and each edge once.

    A node is in one document of an export, with all edges that begin at it, so rows of GraphML are not dealt to find those that repeat.
    """
    if form == "graphml":
        files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "false").text(f"{path}/graphml")
        return store.graphml(files.select(F.col("shard").cast("int").alias("ord"), F.col("value").alias("content")), apart=True)
    if form == "graphson":
        columns = [c.strip() for c in schema.CPG_NODES.split(",")]
        own = ", ".join(c.replace(" ", ": ", 1) for c in columns if c.split()[0] not in ("id", "label"))
        v = spark.read.schema(f"id string, label string, properties STRUCT<{own}>").json(f"{path}/graphson/vertices")
        e = spark.read.schema("outV string, inV string, label string").json(f"{path}/graphson/edges")
        return v.select("id", "label", "properties.*"), e.select(F.col("outV").alias("src"), F.col("inV").alias("dst"), "label")
    if form == "neo4jcsv":
        load = lambda name, form: _unplain(spark.read.schema(form).option("header", "true").option("enforceSchema", "true").option("quote", '"').option("escape", '"').option("nullValue", "\u0000").csv(f"{path}/neo4jcsv/{name}").drop("part"))
        return load("nodes", schema.CPG_NODES), load("edges", schema.CPG_EDGES)
    raise ValueError(f"no export form is called {form}")
