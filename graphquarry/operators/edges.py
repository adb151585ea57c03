"""Edge builders, predicates and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions import words
from ..plans.materialise import broadcast_blocks, broadcast_within, cut, spread
from .graph import SMALL


def symbol_uses(symbols: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, symbol, called): users of a symbol to its definitions, from (node_id, name, kind), and whether they call it; noisy symbols,
    and those of the project that `noise` names, aside.  A definition that is listed twice gives its rows twice."""
    own = symbols.filter(~T.noisy_symbol(F.col("name")) & ~F.col("name").isin(*noise))
    defs = own.filter("kind = 'definition'").select(F.col("node_id").alias("target"), F.col("name").alias("symbol"))
    refs = own.filter("kind IN ('reference', 'call', 'import')").groupBy(F.col("node_id").alias("source"), F.col("name").alias("symbol")).agg(F.bool_or(F.col("kind") == "call").alias("called"))
    return refs.join(defs, "symbol").filter("source <> target").select("source", "target", "symbol", "called")


def reference_edges(symbols: DataFrame, noise: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, symbol) of symbol_uses(), each once."""
    return symbol_uses(symbols, noise).select("source", "target", "symbol").distinct()


#: Lists of up to so many names are looked up by pairs of names, where one name in common is too few.
SHORT_LIST = 12


def name_pairs(names: Column, size: Column) -> Column:
    """All pairs (k1, k2) of the first `size` of a list of names, in the list's order."""
    few = F.slice(names, F.lit(1), F.greatest(size, F.lit(0)))
    return F.flatten(F.transform(few, lambda x, i: F.transform(F.slice(few, i + 2, size), lambda y: F.struct(x.alias("k1"), y.alias("k2")))))


def jaccard_edges(names: DataFrame, threshold: float = 0.2, most: int = 5, sources: DataFrame | None = None, short: int = SHORT_LIST) -> DataFrame:
    """(source, target, score, rank): pairs of nodes by the Jaccard similarity of their names, from (node_id, name).

    A score over the threshold takes more than threshold * n of a node's n names in common, so each node is looked up by all
    but its floor(threshold * n) most frequent names, which leaves the hottest names out of the join; pairs for which
    names were left out are compared by their whole lists, if they can still reach the threshold.  Two lists of up to `short` names for
    which one common name is too few are looked up by pairs of names instead (with one more name each, since two of the common ones
    must be among them), so that no row is made for two nodes with one name in common.  Each lower node keeps its `most` best.  With
    `sources` (node_id), only the edges of these as lower nodes are made.  Lookups that the longest list leaves nothing to are not planned.
    """
    own = names.select("node_id", F.lower("name").alias("name")).distinct()
    df = own.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    lists = own.join(df, "name").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("df", "name"))).alias("l"))
    lists = cut(lists.select("node_id", F.transform("l", lambda x: x["name"]).alias("names")))
    longest = lists.agg(F.max(F.size("names")).alias("n")).first()["n"] or 0
    n, left_out = F.size("names"), F.floor(F.size("names") * threshold + 1e-9).cast("int")
    lower = lists if sources is None else lists.join(sources, "node_id", "left_semi")
    score = lambda both: both / (F.col("n_source") + F.col("n_target") - both)
    is_long, one_does = F.greatest("n_source", "n_target") > short, score(F.lit(1)) > threshold

    def side(df: DataFrame, end: str, out: Column, key: Column) -> DataFrame:
        return df.select(F.col("node_id").alias(end), n.alias(f"n_{end}"), out.alias(f"out_{end}"), key)

    keys = ("source", "target", "n_source", "n_target", "out_source", "out_target")
    seen = lambda a, b, key, which: a.join(b, key).filter(F.col("source") < F.col("target")).filter(which).groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"))
    by_name = lambda df, end: side(df, end, left_out, F.explode(F.slice("names", F.lit(1), n - left_out)).alias("name"))
    single = F.lit(1) / n > threshold  # a node that one common name can do for
    found = [seen(by_name(lower.filter((n <= short) & single), "source"), by_name(lists.filter((n <= short) & single), "target"), "name", one_does)]
    if longest > short:
        found.append(seen(by_name(lower.filter(n > short), "source"), by_name(lists, "target"), "name", is_long))
        found.append(seen(by_name(lower.filter(n <= short), "source"), by_name(lists.filter(n > short), "target"), "name", is_long))
    if min(longest, short) > 1 and not 1 / (2 * min(longest, short) - 1) > threshold:
        left_too = F.greatest(left_out - 1, F.lit(0))
        in_pairs = lambda df, end: side(df.filter((n > 1) & (n <= short)), end, left_too, F.inline(name_pairs(F.col("names"), n - left_too)))
        twos = seen(in_pairs(lower, "source"), in_pairs(lists, "target"), ["k1", "k2"], ~one_does)
        # k common pairs are of c names, where k = c * (c - 1) / 2
        found.append(twos.withColumn("seen", F.round((1 + F.sqrt(1 + 8 * F.col("seen"))) / 2).cast("long")))
    pairs = reduce(DataFrame.unionByName, found)
    unseen = F.col("out_source") + F.col("out_target")  # names that the pair may share besides
    pairs = pairs.filter(score(F.least(F.col("seen") + unseen, F.col("n_source"), F.col("n_target"))) > threshold)
    scored = pairs.filter(unseen == 0).select("source", "target", score(F.col("seen")).alias("score"))
    if longest * threshold + 1e-9 >= 1:  # some names are left out
        x, y = lists.select(F.col("node_id").alias("source"), F.col("names").alias("x")), lists.select(F.col("node_id").alias("target"), F.col("names").alias("y"))
        scored = scored.unionByName(pairs.filter(unseen > 0).join(x, "source").join(y, "target").select("source", "target", score(F.size(F.array_intersect("x", "y"))).alias("score")))
    scored = scored.filter(F.col("score") > threshold)
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def grams(text: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))).otherwise(T.strings([]))


#: Lengths of the runs that a needle is looked up by: the longest that it has; three characters say little among many texts.
GRAMS = (12, 6, 3)


def longest_grams(text: Column) -> Column:
    """The distinct runs of a needle, of the first of GRAMS that it is long enough for."""
    out = T.strings([])
    for n in reversed(GRAMS):
        out = F.when(F.length(text) >= n, grams(text, n)).otherwise(out)
    return out


def all_grams(text: Column, sizes: tuple[int, ...] = GRAMS) -> Column:
    """The distinct runs of a text, of each of the sizes."""
    return F.concat(*[grams(text, n) for n in sizes]) if sizes else T.strings([])


def used_grams(needles: DataFrame, text: Column) -> tuple[int, ...]:
    """Those of GRAMS that longest_grams() takes of these needles."""
    size = F.lit(None).cast("int")
    for n in reversed(GRAMS):
        size = F.when(F.length(text) >= n, n).otherwise(size)
    return tuple(r.n for r in needles.select(size.alias("n")).distinct().filter("n IS NOT NULL").collect())


def by_rarest(needles: DataFrame, texts: DataFrame, small: int = SMALL) -> DataFrame:
    """(needle, id): of needles (needle, keys) and texts (id, keys), the pairs where the text has the needle's rarest key: all that can
    match, where a match needs every key of the needle.  Needles without keys are not looked up.

    Keys go as 64-bit hashes, since what is found is checked in full.  Spark takes a table of exploded keys for as small as its
    file, so the index has a hint that keeps it from being broadcast; the needles are, if they are few.
    """
    index = texts.select("id", F.explode("keys").alias("key")).select("id", F.xxhash64("key").alias("key")).hint("merge")
    wanted = cut(needles.select("needle", F.explode(F.array_distinct("keys")).alias("key")).select("needle", F.xxhash64("key").alias("key")))
    keys = cut(wanted.select("key").distinct())
    df = cut(index.join(broadcast_within(keys, small), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("df")))
    rarest = wanted.hint("merge").join(broadcast_within(df, small), "key", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r"))
    rarest = cut(rarest.filter("r.df > 0").select("needle", F.col("r.key").alias("key")))
    return index.join(broadcast_within(rarest, small), "key").select("needle", "id")


def active(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    n = nodes.select("node_id")
    return edges.join(n.withColumnRenamed("node_id", "source"), "source", "left_semi").join(n.withColumnRenamed("node_id", "target"), "target", "left_semi")


def without_superseded(edges: DataFrame) -> DataFrame:
    """Edges whose source nothing supersedes."""
    old = edges.filter("type = 'supersedes'").select(F.col("target").alias("source")).distinct()
    return edges.join(old, "source", "left_anti")


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, item): dangling edges, self-loops, unknown edge types, malformed hashes."""
    n = nodes.select("node_id")
    key = F.concat_ws("->", "source", "target")
    no_source = edges.join(n.withColumnRenamed("node_id", "source"), "source", "left_anti").select("source", "target")
    no_target = edges.join(n.withColumnRenamed("node_id", "target"), "target", "left_anti").select("source", "target")
    dangling = no_source.union(no_target).distinct().select(F.lit("dangling").alias("check"), key.alias("item"))
    loops = edges.filter("source = target").select(F.lit("self_loop").alias("check"), key.alias("item"))
    kinds = edges.filter(~F.col("type").isin(*schema.EDGE_TYPES)).select(F.lit("bad_type").alias("check"), F.concat_ws(":", key, "type").alias("item"))
    hashes = nodes.filter(~F.col("hash").rlike("^[a-f0-9]{40}$")).select(F.lit("bad_hash").alias("check"), F.col("node_id").alias("item"))
    return dangling.union(loops).union(kinds).union(hashes)


def report(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without dangling ends and self-loops."""
    return active(edges, nodes).filter("source <> target")


def build_warnings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: orphans, dangling edges, self-loops, nodes without entities and whether these are over half.

    nodes: (node_id, n_entities).
    """
    ends = edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()
    flags = nodes.join(ends.withColumn("linked", F.lit(1)), "node_id", "left")
    by_node = flags.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("linked").isNull()).alias("orphans"), F.count_if(F.col("n_entities") == 0).alias("bare"))
    n = nodes.select("node_id").withColumn("k", F.lit(1))
    checked = edges.join(n.select(F.col("node_id").alias("source"), F.col("k").alias("s")), "source", "left").join(n.select(F.col("node_id").alias("target"), F.col("k").alias("t")), "target", "left")
    by_edge = checked.agg(F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("dangling"), F.count_if(F.col("source") == F.col("target")).alias("self_loops"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  both have a single row
    return one(by_node).join(one(by_edge), "one").select("orphans", "dangling", "self_loops", F.col("bare").alias("without_entities"), (F.col("bare") > 0.5 * F.col("n")).alias("mostly_bare"))


def conversation_links(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, ref, target, rule): references of conversations to the nodes they name, by the first rule that holds:
    path (in the path), name (is or is in the file name), content (a whole word of the content).

    references: (conv_id, ref); nodes: (node_id, path, content).  A reference is looked up by its rarest run of 12, 6 or 3 characters among
    those of the paths, and by its rarest word among those of the contents; what is found is checked in full.  Only references too
    short for that go to all nodes, in parts of a checked size.
    """
    low, path = F.lower("ref"), F.lower("path")
    name = F.element_at(F.split(path, "/"), -1)
    quoted = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])\Q"), F.col("ref"), F.lit(r"\E($|[^\p{L}\p{N}_])"))
    rule = F.when(F.contains(path, low), "path").when((name == low) | F.contains(name, low), "name").when(F.contains("content", F.col("ref")) & F.regexp_like("content", quoted), "content")
    refs, nodes = cut(references.select("ref").distinct()), spread(nodes)
    in_path = by_rarest(refs.select(F.col("ref").alias("needle"), longest_grams(low).alias("keys")), nodes.select(F.col("node_id").alias("id"), all_grams(path, used_grams(refs, low)).alias("keys")))
    in_content = by_rarest(refs.select(F.col("ref").alias("needle"), T.runs(F.col("ref")).alias("keys")), nodes.select(F.col("node_id").alias("id"), F.array_distinct(T.runs(F.col("content"))).alias("keys")))
    pairs = in_path.union(in_content).distinct().select(F.col("needle").alias("ref"), F.col("id").alias("node_id"))
    hits = pairs.join(nodes.hint("merge"), "node_id").filter(rule.isNotNull()).select("ref", F.col("node_id").alias("target"), rule.alias("rule"))
    short = refs.filter((F.length("ref") < 3) | (F.size(T.runs(F.col("ref"))) == 0))
    for part in broadcast_blocks(short):
        hits = hits.unionByName(nodes.join(part, rule.isNotNull()).select("ref", F.col("node_id").alias("target"), rule.alias("rule")))
    return references.hint("merge").join(broadcast_within(cut(hits.distinct()), SMALL), "ref").select(F.col("conv_id").alias("source"), "ref", "target", "rule")


def doc_mentions(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, name, n): how often each document has each entity name as a word; a join on words."""
    words_ = docs.select("doc_id", F.explode(T.runs(F.col("text"))).alias("name"))
    return words_.join(entities.select("name").distinct(), "name").groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))


def endpoint_match(ends: DataFrame, nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, node_id, how): the node of a relation's end, by exact entity name, else where the name occurs: path,
    title, content.  Ties: the least node.

    A name is looked up by its rarest run of 12, 6 or 3 characters in each of the three; only shorter names go to all nodes, in parts.
    """
    low = F.lower("name")
    exact = ends.join(entities.select(F.lower("entity").alias("k"), "node_id"), low == F.col("k")).select("name", "node_id", F.lit(4).alias("w"))
    w = F.when(F.contains(F.lower("path"), low), 3).when(F.contains(F.lower("title"), low), 2).when(F.contains(F.lower("content"), low), 1)
    names, nodes = cut(ends.select("name").distinct()), spread(nodes)
    sizes = used_grams(names, low)
    keys = cut(names.select(F.col("name").alias("needle"), longest_grams(low).alias("keys")))
    found = [by_rarest(keys, nodes.select(F.col("node_id").alias("id"), all_grams(F.lower(c), sizes).alias("keys"))) for c in ("path", "title", "content")]
    pairs = reduce(DataFrame.union, found).distinct().select(F.col("needle").alias("name"), F.col("id").alias("node_id"))
    loose = pairs.join(nodes.hint("merge"), "node_id").filter(w.isNotNull()).select("name", "node_id", w.alias("w"))
    for part in broadcast_blocks(names.filter(F.length("name") < 3)):
        loose = loose.unionByName(nodes.join(part, w.isNotNull()).select("name", "node_id", w.alias("w")))
    how = F.element_at(T.strings(["content", "title", "path", "entity"]), -F.col("best.w"))
    return exact.unionByName(loose).groupBy("name").agg(F.min(F.struct((-F.col("w")).alias("w"), "node_id")).alias("best")).select("name", "best.node_id", how.alias("how"))


def quoted_in(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """(quote, n): how many documents (doc_id, text) have each of the distinct quotes (quote) that any has.

    A quote is looked up by the rarest of its words but the first and the last, which may be cut; quotes without such a word
    go to all documents, in parts.
    """
    inner = F.slice(T.runs(F.col("quote")), 2, F.greatest(F.size(T.runs(F.col("quote"))) - 2, F.lit(0)))
    keys = quotes.select(F.col("quote").alias("needle"), inner.alias("keys"))
    pairs = by_rarest(keys, docs.select(F.col("doc_id").alias("id"), F.array_distinct(T.runs(F.col("text"))).alias("keys")))
    hits = pairs.select(F.col("needle").alias("quote"), F.col("id").alias("doc_id")).join(docs, "doc_id").filter(F.contains("text", "quote")).select("quote")
    for part in broadcast_blocks(quotes.filter(F.size(inner) < 1).select("quote")):
        hits = hits.union(docs.join(part, F.contains("text", "quote")).select("quote"))
    return hits.groupBy("quote").agg(F.count(F.lit(1)).alias("n"))


#: Nodes of a task that lifts documents, about; each is ranked for all queries whose folders lead to it.
LIFTED_ROWS = 50_000


def lifted(retrieved: DataFrame, nodes: DataFrame, levels: int = 2, most: int = 5) -> DataFrame:
    """(query_id, node_id, path, rank): documents of the folders above retrieved nodes, not retrieved themselves.

    retrieved: (query_id, node_id, path).  Readme first, then __init__, architecture and overview, others; ties by path.
    Nodes go in parts of about LIFTED_ROWS to be ranked, so that a task's rows do not grow with the table; only those that some query
    retrieved are compared with its results.
    """
    parts = F.split("path", "/")
    depth = F.sequence(F.size(parts) - 1, F.greatest(F.size(parts) - levels, F.lit(1)), F.lit(-1))
    folders = retrieved.filter(F.size(parts) > 1).select("query_id", F.explode(F.transform(depth, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("folder")).distinct()
    wanted = folders.select("query_id", F.explode(F.transform(T.strings(words.LIFTED_NAMES), lambda n: F.concat(F.col("folder"), F.lit("/"), n))).alias("path"))
    some = retrieved.select("node_id", F.lit(True).alias("again")).distinct().hint("merge")
    marked = nodes.select("node_id", "path").join(some, "node_id", "left")
    marked = cut(marked.repartition(max(1, -(-nodes.count() // LIFTED_ROWS))))
    wanted = broadcast_within(cut(wanted), SMALL)
    again = marked.filter("again").join(wanted, "path").select("query_id", "node_id", "path").join(retrieved.select("query_id", "node_id").hint("merge"), ["query_id", "node_id"], "left_anti")
    found = marked.filter("again IS NULL").join(wanted, "path").select("query_id", "node_id", "path").unionByName(again)
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    first = F.when(name.contains("readme"), 0).when(name.contains("__init__"), 1).when(name.contains("architecture") | name.contains("overview"), 2).otherwise(3)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(first, "path", "node_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "node_id", "path", "rank")


def enriched(results: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, node_id, rank): up to `most` conversations that refer to a query's results."""
    links = edges.filter("type = 'conversation_references_code'").select(F.col("source").alias("conv"), F.col("target").alias("node_id"))
    found = results.select("query_id", "node_id").join(links, "node_id").select("query_id", F.col("conv").alias("node_id")).distinct()
    new = found.join(results, ["query_id", "node_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("node_id"))
    return new.withColumn("rank", rank).filter(F.col("rank") <= most)


def merged(old: DataFrame, new: DataFrame, rewritten: DataFrame) -> DataFrame:
    """New edges, and the old ones that touch no rewritten node."""
    r = rewritten.select("node_id")
    kept = old.join(r.withColumnRenamed("node_id", "source"), "source", "left_anti").join(r.withColumnRenamed("node_id", "target"), "target", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def call_edges(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, callee) of known methods, builtins, dunders, self-calls and unnamed aside."""
    m = methods.select("name").distinct()
    own = calls.select(F.trim("caller").alias("caller"), F.trim("callee").alias("callee")).filter(~T.skipped_call(F.col("caller"), F.col("callee"))).distinct()
    return own.join(m.withColumnRenamed("name", "caller"), "caller", "left_semi").join(m.withColumnRenamed("name", "callee"), "callee", "left_semi")
