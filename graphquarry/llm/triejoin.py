"""Jaccard join of n-gram sets by prefix tokens and tries: links of a least similarity and their connected components.

A text's set are its distinct shingles of four words (all words, where there are fewer), known by 64-bit hashes; equal sets are one
node.  All sets are ordered by one global order: shingles by how many nodes hold them among their first ones, rare ones first, then by hash.
Two sets that link share one of their first `size - least overlap + 1` shingles, so sets meet in the buckets of these.

1. Nodes are put into buckets in the order of hashes.  Shingles whose buckets come out large are counted, and the nodes that
   have one take their first shingles again in the order of these counts, so that large buckets remain of similar sets only.
2. In each bucket one pivot is paired with the others.  The partners of a pivot are stored in tries, dealt out in parts of bounded size,
   and the pivot walks these.
3. In buckets whose other members are then still of several components, tiles of bounded size are stored in a trie and walked by all
   sets of the two tiles of a step; sets of one component are not compared, and a pair in one bucket only.
Both times tries of the first shingles that nodes share come before those of whole sets: up to where the first ones of both sets come, their
overlap is known, and beyond it is at most what remains of either, so most pairs end there; sets whose sizes alone rule out all others are not stored.  Whole sets are read only of nodes that have others left.

A trie holds sets as paths from their most frequent shingle on, so sets with equal parts share nodes.  All sets that walk are taken along at
once: at each node their overlaps grow by the node's shingles, for all sets below it, and those that cannot reach the least overlap with what
remains of them or of the longest set below, or whose size fits none below, stop there.  Overlaps at a path's end are exact.

Null, empty and blank texts have no shingles and link with nothing, not with each other either.  A row with a null id has its n_shingles,
links with nothing and has a null component.  Rows that repeat an id stand for their texts, each in its own text's component.
An empty table gives an empty table.  Only the id of the input's columns is returned, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHasher, blocks, broadcast_within, cut, mix
from .neardup import STEP, shingles, steps

WORDS = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Buckets of more nodes than this are large; at most so many of their shingles are broadcast (16 bytes each), the most frequent first.
LARGE_BUCKET, COUNTED = 64, 1 << 20
#: A tile holds about so many sets and shingles at most, or one set.
TILE_SETS, TILE_ITEMS = 512, 1 << 19
#: A set's first shingles are marked at so many places, so that it can be told how many of them come before one of another set.
MARKS = 16
_S1, _S2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def node_keys(d: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sizes = np.bincount(d, minlength=n)
    ends = np.cumsum(sizes)
    out = []
    for salt in (_S1, _S2):
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix(s ^ salt), out=total[1:])
        out.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def first_ones(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of sets of these sizes meet those of every set they link with."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def places(taken: np.ndarray) -> np.ndarray:
    """(sets, MARKS + 1): how many of `taken` shingles come up to each mark, 0 before the first."""
    return -(-np.arange(MARKS + 1)[None, :] * taken[:, None] // MARKS)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, percent: int, large: Broadcast | None = None, items: bool = False) -> DataFrame:
    """(id, node, check, n, first, marks) of (id, text): the set's keys, its size and its first shingles, or with `items` all of them.

    large: shingles, sorted, and the counts by which they follow those that are not among them.  marks: numbers that grow with the order of
    shingles (equal ones tell nothing) at places() of the first ones.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        known, count = large.value if large is not None else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                m = part.num_rows
                h, doc = words(data, offsets)
                d, s, _ = shingles(h, doc, m, WORDS)
                n = np.bincount(d, minlength=m)
                node, check = node_keys(d, s, m)
                if items:
                    first, marks = lists(s, n), pa.nulls(m, pa.list_(pa.int32()))
                else:
                    grows = (s >> np.uint64(34)).astype(np.int32)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        level = np.where(known[at] == s, count[at], 0)
                        order = np.lexsort((s, level, d))
                        d, s = d[order], s[order]
                        grows = np.where(level > 0, (1 << 30) + np.minimum(level, (1 << 30) - 1), grows)[order].astype(np.int32)
                    taken, starts = first_ones(n, percent), np.cumsum(n) - n
                    first = lists(s[np.arange(len(d)) - np.repeat(starts, n) < taken[d]], taken)
                    some = n > 0
                    values = grows[(starts[some, None] + places(taken[some])[:, 1:] - 1).reshape(-1)]
                    marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * MARKS)]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "node": pa.array(node.view(np.int64)), "check": pa.array(check.view(np.int64)), "n": pa.array(n.astype(np.int64)), "first": first, "marks": marks})

    return docs.mapInArrow(run, f"id {kind}, node long, check long, n long, first array<long>, marks array<int>")


class Trie:
    """Sets of ranks (ascending) as paths; a walk gives the pairs of one walker and one set whose overlap suffices."""

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray) -> None:
        keys = [p.astype(">u4").tobytes() for p in paths]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.paths = [paths[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.lengths = np.array([len(p) for p in self.paths], np.int64)
        self.shared = np.zeros(len(paths) + 1, np.int64)  # with the set before
        for i in range(1, len(paths)):
            a, b = self.paths[i - 1], self.paths[i]
            k = min(len(a), len(b))
            differ = a[:k] != b[:k]
            self.shared[i] = differ.argmax() if differ.any() else k


class Behind:
    """How much of each set may lie behind its first shingles, as far as they and those of another set come."""

    def __init__(self, sizes: np.ndarray, marks: np.ndarray, percent: int) -> None:
        self.sizes, self.marks, self.before = sizes, marks, places(first_ones(sizes, percent))
        self.last = marks[:, -1]

    def at(self, of: np.ndarray | int, mark: np.ndarray) -> np.ndarray:
        """What of the sets may come at or after a mark."""
        many = (self.marks[of] < mark[:, None]).sum(axis=1)
        many = np.where(self.last[of] < mark, MARKS, many)
        return self.sizes[of] - self.before[of, many]

    def both(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most that sets x may have in common with sets y besides first shingles."""
        mark = np.minimum(self.last[x], self.last[y])
        of_x = np.where(self.last[x] < self.last[y], self.sizes[x] - self.before[x, -1], self.at(x, mark))
        of_y = np.where(self.last[y] < self.last[x], self.sizes[y] - self.before[y, -1], self.at(y, mark))
        return np.minimum(of_x, of_y)


def least_overlap(x: np.ndarray, y: np.ndarray | int, percent: int) -> np.ndarray:
    """The overlap that two sizes need."""
    return -(-percent * (x + y) // (100 + percent))


def in_reach(group: np.ndarray, n: np.ndarray, held: np.ndarray, label: np.ndarray, tile: np.ndarray, single: np.ndarray, walks: np.ndarray, behind: Behind | None, percent: int) -> np.ndarray:
    """Which rows have another one in their group that their sizes alone don't rule out; held: how many shingles each has here."""
    reach = np.zeros(len(group), bool)
    for d in range(1, len(group)):
        x = np.flatnonzero(group[d:] == group[:-d])
        if not len(x):
            break
        y = x + d
        open_ = (label[x] != label[y]) & (single[x] | (tile[x] != tile[y])) & (walks[x] | walks[y])
        open_ &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        x, y = x[open_], y[open_]
        most = np.minimum(held[x], held[y]) + (behind.both(x, y) if behind else 0)
        open_ = most >= least_overlap(n[x], n[y], percent)
        reach[x[open_]] = reach[y[open_]] = True
    return reach


def trie_links(
    sets: list[np.ndarray], sizes: np.ndarray, marks: np.ndarray | None, label: np.ndarray, tile: np.ndarray, single: bool, walkers: np.ndarray, percent: int, bucket: int | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (i, j) of sets of different labels and, unless single, different tiles, with i or j a walker, whose overlap suffices; and which sets are in one.

    Without marks sets are whole, and the pairs are links: a link makes two labels one, and pairs of one label are left out, so that there are
    fewer links than labels.  With marks they are first shingles, of whole sets of these sizes, and no pairs are made; bucket: only those pairs count
    whose least common shingle it is, so that a pair counts in one bucket.
    """
    whole = marks is None
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    names, rank, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # shingles that rule a pair out where it has them in common, then most frequent first, those of one set last
    ruling = np.zeros(len(names), bool) if bucket is None else names < np.uint64(bucket)
    by = np.lexsort((names, -held, ~ruling, held == 1))
    some, out_of = int((held > 1).sum()), int((ruling & (held > 1)).sum())
    place = np.empty(len(names), np.int64)
    place[by] = np.arange(len(names))
    rank = place[rank]
    paths = [np.sort(r[r < some]) for r in (rank[a:b] for a, b in zip(ends, ends[1:], strict=False))]
    trie = Trie(paths, sizes)
    label, tile = label[trie.order].copy(), tile[trie.order]
    behind = None if whole else Behind(trie.sizes, marks[trie.order], percent)
    found = np.zeros(len(sets), bool)
    walks = np.flatnonzero(np.isin(trie.order, walkers))
    all_walk = len(walks) == len(sets)
    flat = np.concatenate([i * some + p for i, p in enumerate(trie.paths)]) if some else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(trie.lengths)])
    out: list[tuple[int, int]] = []
    step = max(1, (32 << 20) // max(some, 1))
    for at in range(0, len(walks), step):
        own = walks[at : at + step]
        has = np.zeros((some, len(own)), np.uint8)
        for k, i in enumerate(own):
            has[trie.paths[i], k] = 1
        n = trie.sizes[own]
        stack = [(0, len(sets), 0, np.arange(len(own)), np.zeros(len(own), np.int64))]
        while stack:
            lo, hi, depth, live, overlap = stack.pop()
            to = int(min(trie.shared[lo + 1 : hi].min(initial=trie.lengths[lo]), trie.lengths[lo:hi].min()))
            below, longest = trie.sizes[lo:hi], int(trie.lengths[lo:hi].max())
            one = label[lo] if (label[lo:hi] == label[lo]).all() else None
            fits = (100 * n[live] >= percent * below.min()) & (100 * below.max() >= percent * n[live])
            if all_walk:
                fits &= own[live] > lo  # a pair once
            if one is not None:
                fits &= label[own[live]] != one
            live, overlap = live[fits], overlap[fits]
            needed = least_overlap(n[live], int(below.min()), percent)
            if behind:
                needed = needed - behind.at(own[live], np.minimum(behind.last[own[live]], behind.last[lo:hi].min()))
            path = trie.paths[lo]
            bound = int(np.searchsorted(path[:to], out_of))
            while len(live) and depth < to:
                upto = min(to, depth + 64, bound if depth < bound else to)
                common = has[path[depth:upto][:, None], live].sum(axis=0, dtype=np.int64)
                if depth < bound:
                    live, overlap, needed = (x[common == 0] for x in (live, overlap, needed))
                    if not len(live):
                        break
                else:
                    overlap = overlap + common
                depth = upto
                left = starts[own[live] + 1] - np.searchsorted(flat, own[live] * some + path[depth - 1], side="right")
                can = overlap + np.minimum(left, longest - depth) >= needed
                live, overlap, needed = live[can], overlap[can], needed[can]
            if not len(live):
                continue
            first = lo
            while first < hi and trie.lengths[first] == to:  # sets that end here come first
                x = own[live]
                most = overlap + behind.both(x, np.full(len(x), first)) if behind else overlap
                hit = (most >= least_overlap(n[live], int(trie.sizes[first]), percent)) & (label[x] != label[first])
                hit &= (single | (tile[x] != tile[first])) & ((x > first) | (not all_walk))
                if hit.any():
                    found[trie.order[x[hit]]] = found[trie.order[first]] = True
                for k in x[hit].tolist() if whole else ():
                    if label[k] != label[first]:
                        label[label == label[k]] = label[first]
                        out.append((int(trie.order[k]), int(trie.order[first])))
                first += 1
            if first < hi:
                turns = [first, *(first + 1 + np.flatnonzero(trie.shared[first + 1 : hi] == to)).tolist(), hi]
                stack += [(a, b, to, live, overlap) for a, b in zip(turns, turns[1:], strict=False)]
    return out, found


def walked(rows: DataFrame, percent: int, whole: bool, once: bool = False) -> DataFrame:
    """The links (a, b) of dealt rows (bucket, lo, hi, tile, walks, node, label, n, items), or where items are not whole sets the
    members (bucket, node) that may have one; once: a pair counts in the bucket of its least common shingle."""
    names = ("a", "b") if whole else ("bucket", "node")

    def of_steps(t: pa.Table) -> pa.RecordBatch:
        k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in STEP], 1)
        turns = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        node, label, tile, n, walks = (t.column(c).to_numpy() for c in ("node", "label", "tile", "n", "walks"))
        marks = None if whole else t.column("marks").chunk(0).flatten().to_numpy().reshape(-1, MARKS)
        items = t.column("items").chunk(0)
        ends, values = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
        group, single = np.repeat(np.arange(len(turns) - 1), np.diff(turns)), k[:, 1] == k[:, 2]
        size = np.diff(ends).astype(np.int64)
        if once:  # common shingles are the bucket's and those after it
            of = np.repeat(np.arange(len(size)), size)
            size = np.bincount(of[values[ends[0] : ends[-1]] >= k[:, 0].view(np.uint64)[of]], minlength=len(size))
        out = []
        reach = in_reach(group, n, size, label, tile, single, walks.astype(bool), None if whole else Behind(n, marks, percent), percent)
        at = np.flatnonzero(reach)
        for own in np.split(at, np.flatnonzero(np.diff(group[at])) + 1):
            if len(own):
                i = own[0]
                sets = [values[ends[x] : ends[x + 1]] for x in own.tolist()]
                pairs, found = trie_links(sets, n[own], None if whole else marks[own], label[own], tile[own], bool(single[i]), np.flatnonzero(walks[own]), percent, int(k[i, 0]) % (1 << 64) if once else None)
                out += [(node[own[x]], node[own[y]]) for x, y in pairs] if whole else [(k[i, 0], x) for x in node[own][found].tolist()]
        both = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({c: pa.array(both[:, x].copy()) for x, c in enumerate(names)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steps(batches):
            yield of_steps(t)

    return rows.repartition(*STEP).sortWithinPartitions(*STEP, "node").mapInArrow(run, f"{names[0]} long, {names[1]} long").distinct()


def tiles(n: str = "n") -> Column:
    """How many tiles rows are dealt into."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum(n) / TILE_ITEMS)).cast("int")


def star_rows(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of each pivot and its partners, of pairs (a: pivot, node, n: its size); a pivot goes with each tile of its partners."""
    parts = pairs.groupBy("a").agg(tiles().alias("parts"))
    partners = pairs.join(parts, "a").withColumn("part", F.pmod(F.hash("node"), F.col("parts"))).select("a", "part", "node", F.lit(False).alias("walks"))
    pivots = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(True).alias("walks"))
    rows = partners.unionByName(pivots).join(sets, "node")
    return rows.select(F.col("a").alias("bucket"), F.col("part").alias("lo"), F.col("part").alias("hi"), F.col("part").alias("tile"), "walks", "node", F.col("node").alias("label"), "n", "items", "marks")


def tile_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of two tiles each of members (bucket, node, label, n); no step has two tiles of a bucket's largest label."""
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("k", "label", "items")).alias("most"), F.sum("k").alias("n"), F.sum("items").alias("items"))
    dealt = lambda k, items: F.ceil(F.greatest(k / TILE_SETS, items / TILE_ITEMS)).cast("int")
    sizes = sizes.select("bucket", F.col("most.label").alias("large"), dealt(F.col("n") - F.col("most.k"), F.col("items") - F.col("most.items")).alias("few"), dealt(F.col("most.k"), F.col("most.items")).alias("many"))
    is_large, h = F.col("label") == F.col("large"), F.hash("node")
    rows = members.join(sizes, "bucket").withColumn("tile", F.when(is_large, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))))
    others = F.sequence(F.lit(0), F.when(is_large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("other", F.explode(others)).select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", F.lit(True).alias("walks"), "node", "label")
    return rows.join(sets, "node")


def trie_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, large_bucket: int = LARGE_BUCKET, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, n_shingles, component_id), a row a document."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(sketches(source, percent))
    nodes = rows.filter("id is not null and n > 0").groupBy("node", "check")
    nodes = cut(nodes.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("marks").alias("marks")))

    def texts_of(wanted: DataFrame) -> DataFrame:
        ids = cut(nodes.join(wanted, "node").select(F.col("rep").alias("id")).distinct())
        return source.join(broadcast_within(ids, broadcast_rows), "id", "left_semi")

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = sketches(texts_of(wanted), percent, items=True).select("node", "n", F.col("first").alias("items"), "marks")
        return cut(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    def shared(of: DataFrame) -> DataFrame:
        """(bucket, k, pivot) of the buckets of several nodes."""
        return cut(of.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("pivot")).filter("k > 1"))

    spread = nodes.select("node", "n", F.explode("first").alias("bucket"))
    buckets = shared(spread)
    top = buckets.filter(F.col("k") > large_bucket).orderBy(F.desc("k"), "bucket").limit(COUNTED).select("bucket", "k").toArrow()
    if top.num_rows:
        known, k = top.column("bucket").to_numpy().view(np.uint64), top.column("k").to_numpy()
        order = np.argsort(known)
        large = spark.sparkContext.broadcast((known[order], k[order]))
        changed = cut(spread.join(F.broadcast(spark.createDataFrame(top)), "bucket", "left_semi").select("node").distinct())
        anew = sketches(texts_of(changed), percent, large).select("node", F.col("first").alias("anew"), F.col("marks").alias("marked")).join(changed, "node", "left_semi").dropDuplicates(["node"])
        nodes = cut(nodes.join(anew, "node", "left").select("node", "check", "rep", "copies", "n", F.coalesce("anew", "first").alias("first"), F.coalesce("marked", "marks").alias("marks")))
        spread = nodes.select("node", "n", F.explode("first").alias("bucket"))
        buckets = shared(spread)
    members = cut(spread.join(broadcast_within(buckets, broadcast_rows), "bucket").select("bucket", "node", "n", "pivot"))
    shared_first = cut(members.groupBy("node").agg(F.collect_list("bucket").alias("items")).join(nodes.select("node", "n", "marks"), "node"))

    def left(rows_of: Callable[[DataFrame, DataFrame], DataFrame], asked: DataFrame) -> DataFrame:
        """Links of the asked pairs or members: first ones decide which of them whole sets are compared of."""
        open_ = cut(walked(rows_of(asked, shared_first), percent, whole=False, once=rows_of is tile_rows))
        key = asked.columns[0]
        still = asked.join(open_.select(F.col("bucket").alias(key), "node"), [key, "node"], "left_semi")
        return cut(walked(rows_of(still, sets_of(open_.select("node").distinct())), percent, whole=True))

    others = members.filter("node <> pivot")
    stars = others.select(F.col("pivot").alias("a"), "node", "n").distinct().join(nodes.select(F.col("node").alias("a"), F.col("n").alias("pivot_n")), "a")
    stars = cut(stars.filter(F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent).select("a", "node", "n"))
    links = left(star_rows, stars)
    classes = connected_components(links, "a", "b")
    labelled = others.join(classes.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bucket")
    more = left(tile_rows, cut(labelled.join(mixed, "bucket")))
    if more.limit(1).count():
        classes = connected_components(links.union(more), "a", "b")

    # only texts with copies or links have a component of another id
    of_node = nodes.select("node", "check", "rep", "copies").join(classes.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").filter("copies > 1 or component is not null")
    of_class = of_node.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = cut(of_node.join(of_class, "component", "left").select("node", "check", F.coalesce("least", "rep").alias("component_id")))
    out = rows.select("id", "node", "check", "n").join(broadcast_within(of_node, broadcast_rows), ["node", "check"], "left")
    component = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
