"""Document fingerprints: improbable-feature digests of byte windows in chained Bloom filters.

Every 16-byte window of a text has an entropy; the further it lies from that of ordinary prose, the rarer the
window counts.  Windows that are the rarest of enough of their neighbourhoods become features.  Features, in text
order, fill Bloom filters of 2048 bits, at most 160 each; the chain of filters is the fingerprint.  Two chains
are compared by the bit overlap of their filters, normalised so that overlap by chance is 0 and equality is 1.

A null text counts as empty.  A text shorter than a window is one feature, an empty one has none: its
fingerprint is "0:", like only to another such (1.0).  Equal texts have equal fingerprints wherever they stand.
Texts of any length are read whole.  Rows are ordered by (id, hash of the text, text), null ids first, so repeated ids and rows have
a defined next row; the row after the last is the first, for a single row itself.  Ids may be of any type with an order.
Only the id of the input's columns is returned, so others may have any name.  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, powers

WINDOW, NEIGHBOURS, POPULAR = 16, 32, 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Entropy of windows of ordinary prose, in thousandths of the most; windows under LEAST are noise.
TYPICAL, LEAST = 788, 100
#: Share of the possible overlap beyond chance that still counts as none.
SLACK = 0.1
_LANE = 1024
_BASE = 0xD1342543DE82EF95
_counts = np.arange(WINDOW + 1, dtype=float)
_NLOGN = np.round(np.where(_counts > 0, _counts * np.log2(np.maximum(_counts, 1)), 0) * 65536).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_NLOGN)]).astype(np.int32)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def entropy_scores(x: np.ndarray) -> np.ndarray:
    """Entropy of the window that starts at each byte, 0 to 1000; integer sums, so equal windows score equally.

    The buffer is cut into lanes; all lanes slide by one byte at a time together.
    """
    n = len(x) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    lanes = -(-n // _LANE)
    padded = np.zeros(lanes * _LANE + WINDOW, np.uint8)
    padded[: len(x)] = x
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, _LANE + WINDOW)[::_LANE].T)
    counts = np.zeros(lanes * 256, np.uint8)
    base = np.arange(lanes, dtype=np.int32) * 256
    out = np.empty((_LANE, lanes), np.int32)
    total = np.zeros(lanes, np.int32)
    for j in range(WINDOW):
        i = base + rows[j]
        c = counts[i] + np.uint8(1)
        counts[i] = c
        total += _STEP[c]
    out[0] = total
    for j in range(1, _LANE):
        i = base + rows[j - 1]
        c = counts[i]
        total -= _STEP[c]
        counts[i] = c - np.uint8(1)
        i = base + rows[j + WINDOW - 1]
        c = counts[i] + np.uint8(1)
        counts[i] = c
        total += _STEP[c]
        out[j] = total
    most = int(_NLOGN[WINDOW])
    return ((most - out.T.reshape(-1)[:n].astype(np.int64)) * 1000 // most).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the selected features of every text of a buffer, in text order, each hash once a text.

    The texts are laid out with gaps, so no neighbourhood of one reaches the next.
    """
    sizes = np.diff(offsets)
    texts = len(sizes)
    starts = offsets[:-1] + np.arange(texts) * NEIGHBOURS
    ends = starts + sizes
    n = len(data) + texts * NEIGHBOURS
    place = np.arange(len(data)) + np.repeat(np.arange(texts) * NEIGHBOURS, sizes)
    spaced = np.zeros(n, np.uint8)
    spaced[place] = data
    left = np.zeros(n, np.int64)  # bytes of the text from here on
    left[place] = np.repeat(ends, sizes) - place
    p = powers(n + 1, _BASE)
    q = powers(n + 1, pow(_BASE, -1, 1 << 64))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((spaced.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    long = np.flatnonzero(sizes >= WINDOW)
    if len(long):
        scores = entropy_scores(spaced)
        where = np.uint64((1 << 40) - 1)
        rank = np.where(scores < LEAST, 2000, 1000 - np.abs(scores - TYPICAL)).astype(np.uint64)
        key = (rank << np.uint64(40)) | np.arange(len(scores), dtype=np.uint64)
        whole = left[: len(scores)] >= WINDOW
        key[~whole] = _NONE
        least = np.concatenate([key, np.full(NEIGHBOURS - 1, _NONE)])
        width = 1
        while width < NEIGHBOURS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        chosen = np.bincount((least[: len(key)][whole] & where).astype(np.int64), minlength=len(key)) >= POPULAR
        # the rarest window of each text always counts
        cuts = np.stack([starts[long], ends[long] - WINDOW + 1], 1).reshape(-1)
        best = np.minimum.reduceat(np.append(key, _NONE), cuts)[::2]
        chosen[(best & where).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        docs.append(np.searchsorted(starts, at, side="right") - 1)
        hashes.append(mix((sums[at + WINDOW] - sums[at]) * q[at]))
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    docs.append(short)
    lo, hi = starts[short], ends[short]
    hashes.append(mix((sums[hi] - sums[lo]) * q[lo] + (hi - lo).astype(np.uint64)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((np.arange(len(h)), h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1])
    kept = np.sort(order[first])
    kept = kept[np.argsort(doc[kept], kind="stable")]
    return doc[kept], h[kept]


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The filter chain of each text: an array (filters, BITS / 8) of bytes, with no row for an empty text."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    doc, h = features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    per = np.bincount(doc, minlength=len(texts))
    filters = -(-per // PER_FILTER)
    base = np.cumsum(filters) - filters
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    row = base[doc] + rank // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), bool)
    for k in range(HASHES):
        bits[row, ((h >> np.uint64(12 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [packed[b : b + f] for b, f in zip(base, filters, strict=True)]


def to_string(chain: np.ndarray) -> str:
    return f"{len(chain)}:{chain.tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean over the shorter chain of the best normalised overlap with a filter of the other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    b_set = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    total = 0.0
    for f in a:  # a filter at a time: memory grows with the longer chain, not with the product
        f_set = int(np.bitwise_count(f).sum(dtype=np.int64))
        both = np.bitwise_count(b & f).sum(axis=1, dtype=np.int64)
        most = np.minimum(b_set, f_set)
        chance = b_set * f_set / BITS
        none = chance + SLACK * (most - chance)
        total += max(0.0, float(((both - none) / np.maximum(most - none, 1e-9)).max()))
    return min(1.0, total / len(a))


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def ranged(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> DataFrame:
    """(id, text, key, range, halo): rows dealt by ranges of (id, hash of the text), and in each range the next one's first row
    as its halo.

    The ranges come from a table of ids, hashes and sizes; only the first (id, hash) of each, one for every range_bytes of text, goes
    to the driver and back, for 2^18 ranges at most.  A text is shuffled once, but for the first rows of ranges.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    keys = cut(source.select("id", "key", F.octet_length("text").alias("bytes")))
    size = keys.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    dealt = keys.select("id", "key").repartitionByRange(min(1 << 18, max(16, -(-size // range_bytes))), "id", "key")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "key")).alias("first"))
    splits = sorted((f.some, f.id, f.key) if f.some else (False, None, f.key) for (f,) in firsts.select("first").collect())
    nulls, some = [k for s, _, k in splits if not s], [(i, k) for s, i, k in splits if s]
    sent = docs.sparkSession.sparkContext.broadcast((nulls, some))

    @F.arrow_udf("range int, first boolean")
    def number(ids: pa.Array, keys: pa.Array) -> pa.Array:
        nulls, some = sent.value
        at, first = [], []
        for i, k in zip(ids.to_pylist(), keys.to_pylist(), strict=True):
            if i is None:
                n = bisect_right(nulls, k) - 1
                first.append(nulls[n] == k)
                at.append(n)
            else:
                n = bisect_right(some, (i, k)) - 1
                first.append(n >= 0 and some[n] == (i, k))
                at.append(len(nulls) + n)
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(first, pa.bool_())], ["range", "first"])

    n = max(1, len(splits))
    own = F.struct(F.col("at.range").alias("range"), F.lit(False).alias("halo"))
    before = F.struct(F.pmod(F.col("at.range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("halo"))
    to = F.when(F.col("at.first"), F.array(own, before)).otherwise(F.array(own))
    return source.withColumn("at", number("id", "key")).select("id", "text", "key", F.inline(to))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 4 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text (the last half of its code points replaced by
    the start of the next document), and how like its own these and the next document's are."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    dealt = ranged(docs, id_col, text_col, range_bytes).repartition("range").sortWithinPartitions("range", "halo", "id", "key", "text").drop("key")

    def rows(ids: list, id_type: pa.DataType, texts: list[str], edits: list[str]) -> pa.RecordBatch:
        """texts has one more than ids: the row that follows the last."""
        raw = [e.encode() for e in edits]
        chains = digests([t.encode() for t in texts] + raw)
        own, changed = chains[: len(texts)], chains[len(texts) :]
        return pa.RecordBatch.from_pydict(
            {
                id_col: pa.array(ids, id_type),
                "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
                "fingerprint": [to_string(c) for c in own[:-1]],
                "edited_fingerprint": [to_string(c) for c in changed],
                "near_edited": [likeness(a, b) for a, b in zip(own[:-1], changed, strict=True)],
                "near_next": [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, halo_seen = None, False
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for i_, t, r, h in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), part.column("range").to_pylist(), part.column("halo").to_pylist(), strict=True):
                    if h and halo_seen and r == at:
                        continue
                    if ids and (h or size >= block_bytes) and r == at:
                        yield rows(ids, batch.schema.field("id").type, [*texts, t], [edited(a, b) for a, b in zip(texts, [*texts[1:], t], strict=True)])
                        ids, texts, size = [], [], 0
                    at, halo_seen = r, h
                    if not h:
                        ids.append(i_)
                        texts.append(t)
                        size += len(t)

    return dealt.mapInArrow(run, schema)
