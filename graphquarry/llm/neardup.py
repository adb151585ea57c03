"""Near-duplicate classes: ProbMinHash signatures of weighted word shingles, banding, exact verification.

Words are lower-cased and split at white space; texts with equal words are copies, and one node stands for them all.
A shingle of five words (all words, where there are fewer) weighs 1 + ln of how often it occurs.  Each shingle
is a Poisson process with its weight as rate whose arrivals fall on random registers; a register keeps its first
arrival's shingle, and a text stops once no arrival can come first any more.  Two registers are then equal
with the probability Jaccard similarity.  Texts equal in all registers of a band share a bucket.

A pair is a link if the Jaccard similarity of its distinct shingles, computed in full, is at least the threshold.  That is the
probability Jaccard similarity at weight 1.  Where shingles repeat, the weighted one can be far under it, so a text with
repeats has a second signature with all weights 1 and stands in the buckets of both (without repeats the two are the same).
Only signatures of weight 1 prune: a pair is compared in full if the lowest bits of their registers agree as often as at the
threshold, but for 4.5 standard deviations.

1. In each bucket a pivot, another one in each, is paired with all others.
2. Of buckets whose other members are then still of several classes, the members that the signatures do not rule out to
   be linked with one of another class are kept.
3. These are compared in tiles of bounded size, pair by pair, but for pairs of one class; a link found joins the two classes for the
   rest of the tile.  No list of a bucket's pairs is ever made, and no two tiles of a bucket's largest class meet.
So only pairs already in one class are left out.  Classes are the connected components of the links; the class id is its
least document id.

A row with a null id is a class of its own without an id and is kept.  Null and empty texts (no words) are copies of each
other.  Rows that repeat an id belong to one class if their words are equal.  An empty table gives an empty table.
Only the id of the input's columns is returned, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import WordHasher, blocks, broadcast_within, cut, mix

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 7
REGISTERS = BANDS * ROWS
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, doc: np.ndarray, n: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times), each shingle once a text, sorted by both; h and doc are the words of n texts."""
    sizes = np.bincount(doc, minlength=n)
    starts = np.cumsum(sizes) - sizes
    d, s = [], []
    if len(h) >= words:
        m = len(h) - words + 1
        x = h[:m].copy()
        for k in range(1, words):
            x = x * _C + h[k : k + m]
        inside = doc[:m] == doc[words - 1 :]
        d.append(doc[:m][inside])
        s.append(mix(x[inside]))
    for size in range(1, words):
        few = np.flatnonzero(sizes == size)
        x = np.zeros(len(few), np.uint64)
        for k in range(size):
            x = x * _C + h[starts[few] + k]
        d.append(few)
        s.append(mix(x + np.uint64(size)))
    d, s = np.concatenate(d), np.concatenate(s)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return d, s, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])]))
    return d[first], s[first], np.diff(np.append(first, len(d)))


def prob_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """(n, registers): the item that arrives first at each register; rows of texts without items are 0."""
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(doc))
    step = 0
    while len(doc):
        many = int(np.clip(65536 // len(doc), 1, 64))
        g = mix(item[:, None] + _G * np.arange(step + 1, step + 1 + many, dtype=np.uint64)[None, :])
        gaps = -np.log(((g >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32) / weight[:, None]
        x = at[:, None] + np.cumsum(gaps, axis=1)
        where = doc[:, None] * registers + (((g & np.uint64(0xFFFFFFFF)) * np.uint64(registers)) >> np.uint64(32)).astype(np.int64)
        better = x < first[where]
        xs, ws, items = x[better], where[better], np.broadcast_to(item[:, None], x.shape)[better]
        np.minimum.at(first, ws, xs)
        won = xs == first[ws]
        winner[ws[won]] = items[won]
        at = x[:, -1]
        step += many
        latest = first.reshape(n, registers).max(axis=1)
        go = at < latest[doc]
        doc, item, weight, at = doc[go], item[go], weight[go], at[go]
    return winner.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = np.zeros((len(signature), bands), np.uint64)
    for k in range(rows):
        x = x * _C + signature[:, k::rows][:, :bands]
    return mix(x + np.arange(bands, dtype=np.uint64)[None, :] * _G)


def content_keys(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's words in order."""
    sizes = np.bincount(doc, minlength=n)
    place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    out = []
    for salt in (_C, _G):
        x = mix(h ^ mix(place * salt + salt))
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        ends = np.cumsum(sizes)
        out.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


MARKS = -(-REGISTERS // 64)


def marks_of(signature: np.ndarray) -> np.ndarray:
    """(n, MARKS): the lowest bit of each register."""
    bits = np.zeros((len(signature), MARKS * 64), np.uint8)
    bits[:, :REGISTERS] = signature & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.uint64)


def least_marks(threshold: float, registers: int = REGISTERS) -> int:
    """How many marks of two texts agree at least where they reach the threshold, but for 4.5 standard deviations."""
    p = (1 + threshold) / 2
    return max(0, int(np.floor(registers * (p - 4.5 * (p * (1 - p) / registers) ** 0.5))))


def sketches(docs: DataFrame) -> DataFrame:
    """(id, node, check, bands, m0..) of (id, text): two keys of equal words, the band hashes (none for a text without words)
    and the marks."""
    names = [f"m{i}" for i in range(MARKS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                n = part.num_rows
                h, doc = words(data, offsets)
                k1, k2 = content_keys(h, doc, n)
                d, s, times = shingles(h, doc, n)
                some = np.flatnonzero(np.bincount(doc, minlength=n))
                again = np.unique(d[times > 1])  # texts with repeated shingles
                own = np.isin(d, again)
                weighted = band_hashes(prob_minhash(np.searchsorted(again, d[own]), s[own], 1 + np.log(times[own]), len(again)))
                signature = prob_minhash(d, s, np.ones(len(d)), n)
                bands = np.concatenate([band_hashes(signature)[some], weighted]).view(np.int64)
                of = np.concatenate([some, again])
                bands = bands[np.argsort(of, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n) * BANDS)]).astype(np.int32)
                out = {"id": part.column("id"), "node": pa.array(k1.view(np.int64)), "check": pa.array(k2.view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1)))}
                yield pa.RecordBatch.from_pydict(out | dict(zip(names, map(pa.array, marks_of(signature).view(np.int64).T.copy()), strict=True)))

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node long, check long, bands array<long>, " + ", ".join(f"{m} long" for m in names))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, items) of (id, text): the distinct shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHasher()
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                h, doc = words(data, offsets)
                d, s, _ = shingles(h, doc, part.num_rows)
                ends = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
                node = content_keys(h, doc, part.num_rows)[0]
                yield pa.RecordBatch.from_pydict({"node": pa.array(node.view(np.int64)), "items": pa.ListArray.from_arrays(pa.array(ends), pa.array(s.view(np.int64)))})

    return docs.mapInArrow(run, "node long, items array<long>")


STEP = ("bucket", "lo", "hi")


def dealt(members: DataFrame, own: DataFrame, columns: tuple[str, ...], tile: int) -> DataFrame:
    """members (bucket, node, label) of buckets with several labels, dealt into steps (bucket, lo, hi) of two tiles each, with the
    columns that own (node, columns..) has for their nodes.

    A bucket's largest label is cut into tiles of its own, the other members into theirs; no step has two tiles of the
    largest label.  own is joined to one row a node, which is spread over the node's buckets after it: a group of near copies
    shares many buckets, and what its texts have is then read once for each text.
    """
    sizes = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("k", "label")).alias("most"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    sizes = sizes.select("bucket", F.col("most.label").alias("large"), F.ceil((F.col("n") - F.col("most.k")) / tile).cast("int").alias("few"), F.ceil(F.col("most.k") / tile).cast("int").alias("many"))
    at = members.join(sizes, "bucket").groupBy("node", "label").agg(F.collect_list(F.struct("bucket", "large", "few", "many")).alias("at"))
    is_large = F.col("label") == F.col("large")
    h = F.hash("node")
    rows = at.join(own.select("node", *columns), "node").select("node", "label", *columns, F.inline("at"))
    rows = rows.withColumn("tile", F.when(is_large, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))))
    others = F.sequence(F.lit(0), F.when(is_large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    out = rows.withColumn("other", F.explode(others)).select("bucket", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "label", *columns)
    return out.repartition(*STEP).sortWithinPartitions(*STEP, "node")


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole steps."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in STEP], 1)
        if not len(k):
            continue
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in STEP] != k[0].tolist():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        turns = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(turns):
            yield pa.Table.from_batches([*held, batch.slice(0, int(turns[-1]))]).combine_chunks()
            held = []
        held.append(batch.slice(int(turns[-1]) if len(turns) else 0))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def open_pairs(t: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing marks) of a table of steps: the rows of different labels in a step that the marks do not rule out."""
    k = np.stack([t.column(c).to_numpy().astype(np.int64) for c in STEP], 1)
    group = np.cumsum(np.concatenate([[False], (k[1:] != k[:-1]).any(axis=1)]))
    bits = np.stack([t.column(f"m{i}").to_numpy() for i in range(MARKS)], 1).view(np.uint64)
    label, own, single = t.column("label").to_numpy(), t.column("tile").to_numpy(), k[:, 1] == k[:, 2]
    found = [[np.zeros(0, np.int64)] for _ in range(3)]
    for d in range(1, len(group)):
        at = np.flatnonzero(group[d:] == group[:-d])
        if not len(at):
            break
        at = at[(label[at] != label[at + d]) & (single[at] | (own[at] != own[at + d]))]
        same = REGISTERS - np.bitwise_count(bits[at] ^ bits[at + d]).sum(axis=1, dtype=np.int64)
        ok = same >= least
        for out, x in zip(found, (at[ok], at[ok] + d, same[ok]), strict=True):
            out.append(x)
    return tuple(np.concatenate(x) for x in found)


def undecided(members: DataFrame, own: DataFrame, threshold: float, tile: int = 512) -> DataFrame:
    """(bucket, node): the members (bucket, node, label) that could have a link to one of another label in their bucket; own is
    (node, m0..)."""
    least = least_marks(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steps(batches):
            i, j, _ = open_pairs(t, least)
            at = np.unique(np.concatenate([i, j]))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(t.column("bucket").to_numpy()[at]), "node": pa.array(t.column("node").to_numpy()[at])})

    return dealt(members, own, tuple(f"m{i}" for i in range(MARKS)), tile).mapInArrow(run, "bucket long, node long").distinct()


def tiled_links(members: DataFrame, own: DataFrame, threshold: float, tile: int = 256) -> DataFrame:
    """(a, b): links that join the labels of each bucket, of members (bucket, node, label) and own (node, m0.., bands, items).

    Two texts are compared in the first of the bands of weight 1 that they share, or in any bucket if they share none of these.  A
    link makes their labels one for the rest of the step, so a step gives fewer links than it has labels.
    """
    least = least_marks(threshold)

    def links(t: pa.Table) -> pa.RecordBatch:
        i, j, same = open_pairs(t, least)
        bucket, node = t.column("bucket").to_numpy(), t.column("node").to_numpy()
        bands = t.column("bands").chunk(0).flatten().to_numpy().reshape(-1, BANDS)
        shared = bands[i] == bands[j]
        here = ~shared.any(axis=1) | (bands[i, shared.argmax(axis=1)] == bucket[i])
        i, j, same = i[here], j[here], same[here]
        items = t.column("items").chunk(0)
        ends, values = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
        label = t.column("label").to_numpy().copy()
        out = []
        for at in np.lexsort((-same, bucket[i])):
            x, y = i[at], j[at]
            if label[x] != label[y] and similarity(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]]) >= threshold:
                label[(label == label[y]) & (bucket == bucket[x])] = label[x]
                out.append((node[x], node[y]))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"a": pa.array(pairs.min(axis=1, initial=np.iinfo(np.int64).max)), "b": pa.array(pairs.max(axis=1, initial=np.iinfo(np.int64).min))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in steps(batches):
            yield links(t)

    return dealt(members, own, (*(f"m{i}" for i in range(MARKS)), "bands", "items"), tile).mapInArrow(run, "a long, b long").distinct()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted lists of distinct shingles."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def sets_of(wanted: DataFrame, source: DataFrame, nodes: DataFrame, broadcast_ids: int) -> DataFrame:
    """(node, items) of the wanted nodes (node); only their texts are read for it."""
    ids = cut(nodes.select("node", F.col("rep").alias("id")).join(wanted, "node").select("id").distinct())
    texts = source.join(broadcast_within(ids, broadcast_ids), "id", "left_semi")
    return cut(shingle_sets(texts).join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float, most: int = 512) -> DataFrame:
    """The pairs (a, b) whose similarity is at least the threshold.  A text of many pairs is dealt out, at most about `most` pairs to a task."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    left = sets.join(parts, sets.node == parts.a).select("a", "parts", F.col("items").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt_out = pairs.join(parts, "a").withColumn("part", F.pmod(F.hash("b"), F.col("parts")))
    rows = dealt_out.join(left, ["a", "part"]).join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return rows.filter(both / (F.size("x") + F.size("y") - both) >= threshold).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, broadcast_ids: int = 200_000) -> DataFrame:
    """(id, class_id, kept), a row a document: kept marks the one row of each class whose id is the class id."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).filter("id is not null")
    marks = [f"m{i}" for i in range(MARKS)]
    rows = cut(sketches(source))
    nodes = cut(rows.groupBy("node", "check").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), *[F.first(m).alias(m) for m in marks]))
    spread = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    # a pivot for each bucket, so that texts that share many buckets are compared with many others
    least = F.min(F.col("node").bitwiseXOR(F.col("bucket"))).alias("least")
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), least).filter("n > 1")
    members = cut(spread.join(sizes, "bucket").select("bucket", "node", F.col("least").bitwiseXOR(F.col("bucket")).alias("pivot")))

    own = lambda side: nodes.select(F.col("node").alias(side), *[F.col(m).alias(f"{side}_{m}") for m in marks])
    stars = members.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    agree = F.lit(REGISTERS)
    for m in marks:
        agree = agree - F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}")))
    stars = cut(stars.join(own("a"), "a").join(own("b"), "b").filter(agree >= least_marks(threshold)).select("a", "b"))
    ends = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    links = cut(verified(stars, sets_of(ends, source, nodes, broadcast_ids), threshold))
    classes = connected_components(links, "a", "b")
    labelled = members.filter("node <> pivot").join(classes.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 <> l1").select("bucket")
    labelled = cut(labelled.join(mixed, "bucket"))
    left = cut(undecided(labelled, nodes.select("node", *marks), threshold))
    if left.limit(1).count():
        sets = sets_of(left.select("node").distinct(), source, nodes, broadcast_ids)
        own_left = nodes.select("node", F.slice("bands", 1, BANDS).alias("bands"), *marks).join(sets, "node")
        more = cut(tiled_links(labelled.join(left, ["bucket", "node"]), own_left, threshold))
        if more.limit(1).count():
            classes = connected_components(links.union(more), "a", "b")
    of_node = nodes.select("node", "check", "rep").join(classes.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("node", "check", "rep", "component")
    of_class = of_node.filter("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of_node = of_node.join(of_class, "component", "left").select("node", "check", F.coalesce("least", "rep").alias("class_id"))
    out = rows.select("id", "node", "check").join(of_node, ["node", "check"]).select(F.col("id").alias(id_col), "class_id")
    alone = docs.filter(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast(out.schema["class_id"].dataType).alias("class_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))
