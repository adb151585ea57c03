"""Keeping a store: incremental updates from files, versions, rollback, any number of writers.

A store is a folder of Parquet tables: nodes, symbols, edges, postings, doc_stats and file_hashes.  An update writes a generation of its own with the
rows that are new and the keys that are gone, and then publishes its version, which names the generations that make it up
(plans/commits.py).  So an update writes by the size of the change, readers never see a half-written state, a writer that dies leaves a folder
that sweep() removes, one that was overtaken starts again from the version that is there now, and a rollback is another version.  After
MOST_PARTS generations the next one is whole again.  What was found in a text is kept in the folder `cache` by the text's hash
(plans/cache.py), so no update or whole build looks through a text that an earlier one has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import versions as V
from ..sources import store
from . import commits, index
from .materialise import cut

VERSIONS = (
    "number bigint, version_id string, ts bigint, generation string, own string, node_count bigint, edge_count bigint, file_hash string, "
    "added bigint, modified bigint, deleted bigint"
)
CHANGES = "path string, status string"
MOST_PARTS = 8
PREFIX = "generation-"


class Overtaken(RuntimeError):
    """Other writers published first, as often as a writer may start again."""


@dataclass
class Update:
    version_id: str
    changed: bool
    added: int
    modified: int
    deleted: int


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a store, oldest first; none of a store that is not there."""
    return commits.published(spark, path, VERSIONS)


def version(spark: SparkSession, path: str, version_id: str | None = None) -> Row | None:
    """A version's row, the newest one's by default."""
    rows = versions(spark, path)
    rows = rows if version_id is None else rows.filter(F.col("version_id") == version_id)
    return next(iter(rows.orderBy(F.desc("number")).limit(1).collect()), None)


def changes(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    """(path, status): every file that a version added, modified or deleted."""
    row = version(spark, path, version_id)
    if row is None or not row.own:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(f"{path}/{row.own}/changes")


def generation(spark: SparkSession, path: str, version_id: str | None = None) -> str | None:
    """Where a version's tables are, the newest one's by default."""
    row = version(spark, path, version_id)
    return f"{path}/{row.generation}" if row else None


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("names").alias("name")).select(F.lower("name").alias("name")).distinct()


def update(spark: SparkSession, files: DataFrame, path: str, ts: int, noise: tuple[str, ...] = (), retries: int = 5, watch: Callable[[str], None] = lambda step: None, more: Callable[[DataFrame], DataFrame] | None = None) -> Update:
    """Bring a store up to date with (path, bytes, content) files.

    Only changed files are chunked, indexed and looked through for symbols.  Node ids derive from path, content and order, so nodes of
    equal content keep theirs.  Edges are made anew where a change can reach them: reference and call edges with a new end, and semantic edges
    of nodes that share a name with a new node or one that is gone.  The result equals a whole build.

    If another writer publishes meanwhile, the update starts again from its version, at most `retries` times, and then raises Overtaken.
    watch is told the name of each table before it is written, and "publish".  more gives edges of other families (columns index.EDGES) for
    the nodes of the version; of these an update adds the ones with a new end.
    """
    hashes = cut(files.select("path", F.md5("content").alias("hash")))
    for _ in range(retries + 1):
        done = _attempt(spark, files, hashes, path, ts, noise, watch, more)
        if done:
            return done
    raise Overtaken(f"{path}: overtaken {retries + 1} times")


def _attempt(spark: SparkSession, files: DataFrame, hashes: DataFrame, path: str, ts: int, noise: tuple[str, ...], watch: Callable[[str], None], more: Callable[[DataFrame], DataFrame] | None) -> Update | None:
    """One update from the newest version; None if another one was published before it."""
    number = commits.taken(spark, path) + 1
    last = version(spark, path)
    old = f"{path}/{last.generation}" if last else None
    before = store.read_hashes(spark, old) if old else hashes.limit(0)
    diff = cut(V.file_diff(before, hashes))
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    changed = sum(n for k, n in counts.items() if k != "unchanged")
    if old and not changed:
        return Update(last.version_id, False, 0, 0, 0)
    if old and len(store.folders(old)) >= MOST_PARTS:
        old = None
    name = f"{PREFIX}{number}-{uuid4().hex[:12]}"
    new = f"{path}/{name}"
    stale = diff.filter("status <> 'unchanged'").select("path")
    fresh_files = files.join(stale, "path", "left_semi") if old else files
    built = index.build_nodes(fresh_files)
    watch("nodes")
    store.write_nodes(built, new)
    fresh = spark.read.schema(built.schema).parquet(f"{new}/nodes")  # by its schema, since there may be no rows
    watch("symbols")
    index.cached_symbols(fresh, f"{path}/cache").write.mode("overwrite").parquet(f"{new}/symbols")
    watch("hashes")
    (hashes.join(stale, "path", "left_semi") if old else hashes).write.mode("overwrite").parquet(f"{new}/file_hashes")
    watch("index")
    store.write_index(spark, fresh, "node_id", "content", new)
    watch("vectors")
    store.write_vectors(spark.read.schema("doc_id string, term string, tf int").parquet(f"{new}/postings"), new)
    if old:
        gone = cut(store.read_nodes(spark, old).join(stale, "path", "left_semi").select("node_id", "names"))
        watch("gone")
        store.write_gone(gone, new, "gone_nodes", ("node_id",))
        store.write_gone(gone.select(F.col("node_id").alias("doc_id")), new, "gone_docs", ("doc_id",))
        store.write_gone(stale, new, "gone_files", ("path",))
        at = f"{old},{name}"
        nodes, symbols = store.read_nodes(spark, at), store.read_symbols(spark, at)
        names = _named(gone).union(_named(fresh)).distinct()
        sharing = nodes.select("node_id", F.explode("names").alias("name")).withColumn("name", F.lower("name")).join(names, "name", "left_semi").select("node_id")
        reached = cut(sharing.union(fresh.select("node_id")).distinct())
        lost = cut(reached.union(gone.select("node_id")).distinct())
        edges = store.read_edges(spark, old)
        ended = lambda end: edges.join(gone.select(F.col("node_id").alias(end)), end, "left_semi").select("source", "target", "type")
        remade = edges.filter("type = 'semantic'").join(lost.withColumnRenamed("node_id", "source"), "source", "left_semi").select("source", "target", "type")
        store.write_gone(ended("source").union(ended("target")).union(remade).distinct(), new, "gone_edges", ("source", "target", "type"))
        made = index.build_edges(nodes, symbols=symbols, noise=noise, more=more(nodes) if more else None, sources=reached, touching=fresh.select("node_id"))
    else:
        at = new
        nodes = fresh
        made = index.build_edges(fresh, symbols=spark.read.parquet(f"{new}/symbols"), noise=noise, more=more(fresh) if more else None)
    watch("edges")
    store.write_edges(made, new)
    watch("changes")
    diff.filter("status <> 'unchanged'").select("path", "status").write.mode("overwrite").parquet(f"{new}/changes")
    version_id = f"v{number}"
    row = {
        "version_id": version_id, "ts": ts, "generation": ",".join(f.rsplit("/", 1)[-1] for f in store.folders(at)), "own": name,
        "node_count": nodes.count(), "edge_count": store.read_edges(spark, at).count(), "file_hash": V.manifest_hash(hashes).first()["hash"],
        **{k: counts.get(k, 0) for k in ("added", "modified", "deleted")},
    }
    watch("publish")
    if not commits.claim(spark, path, number, row):
        return None
    return Update(version_id, True, row["added"], row["modified"], row["deleted"])


def difference(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """(path, status): the files in which two versions differ."""
    a, b = (store.read_hashes(spark, generation(spark, path, v)) for v in (old, new))
    return V.file_diff(a, b).filter("status <> 'unchanged'")


def rollback(spark: SparkSession, path: str, version_id: str, ts: int, retries: int = 5) -> str:
    """A new version with the tables of an older one."""
    for _ in range(retries + 1):
        every, number = versions(spark, path), commits.taken(spark, path) + 1
        target = V.rollback_targets(every, version(spark, path).version_id).filter(F.col("version_id") == version_id).collect()
        if not target:
            raise ValueError(f"{version_id} is no earlier version")
        r = target[0]
        row = {"version_id": f"v{number}", "ts": ts, "own": "", "added": 0, "modified": 0, "deleted": 0}
        if commits.claim(spark, path, number, row | {c: r[c] for c in ("generation", "node_count", "edge_count", "file_hash")}):
            return f"v{number}"
    raise Overtaken(f"{path}: overtaken {retries + 1} times")


def sweep(spark: SparkSession, path: str, now: int, older: int = 86_400_000) -> list[str]:
    """Remove the generations that no version has and that nobody wrote to for `older` ms before `now`; their names."""
    used = {g for r in versions(spark, path).select("generation", "own").collect() for g in [*r.generation.split(","), r.own]}
    return commits.sweep(spark, path, used, PREFIX, now - older)


def check(spark: SparkSession, path: str) -> DataFrame:
    """Violations of the newest version's invariants, by check."""
    at = generation(spark, path)
    return E.report(E.violations(store.read_nodes(spark, at), store.read_edges(spark, at)))
