"""Language-model scoring with a log-frequency Bloom filter of quantised counts of words, word pairs and word triples.

Texts are put into blocks.  Each block deals its distinct grams (hashes; words of 64 bits, the others of 48), with their
counts in the training texts, to slices of the hash space.  A slice adds up the counts and fills its part of the filter: the
level of a count is the whole part of its logarithm, plus 1, and a gram enters once for each of its levels.  It is read
back by probing level after level until one is missing.  A part is sized for all entries of its slice, so the model grows
with the input and no gram is left out.

Up to small_bytes of text, where the whole filter has a proven bound (a gram has at most as many levels as occurrences), its parts
are put together and broadcast.  Beyond, a part stays with its slice, which probes it for the grams that the blocks have dealt to it
and sends the levels back to the blocks; the scores are the same.  Blocks are made anew from a scan when their answers come; those of
an input that takes a shuffle, whose order could change, are kept in the checkpoint folder.

Score: sum of log10 p over the tokens, each given the two before it:
  p1 = (c(w) + 1) / (sum of c + V + 1),    p2 = a * (c(h, w) - DISCOUNT)+ / c(h) + (1 - a) * p1,    p = the same from p2 with the two words before,
with c read from the filter and a = c(h) / (c(h) + trust).  A level stands for its middle count in p1, for its least count
where it is divided and its greatest where it divides (c(h) of one word is exact), so the p of all words and one
unknown word sum to 1 at most, but for false positives of the filter (under one in a hundred).
The base score and n_known take exact counts.

A null or empty text has the end token only.  Without training texts N, V and all counts are 0, the base score
is 0 and the score is 0.  Repeated rows are scored, and counted, each by itself; an empty table gives an empty table.
Only the id of the input's columns is returned, so others may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, cut, give_back, mix, text_buffer

END, START = np.uint64(0x51ED270B35A9E1C7), np.uint64(0xA0761D6478BD642F)
BASE = 1.5
LEVELS = 64
PROBES = 5
DISCOUNT = 0.75
ROOM = 16  # bits a level entry
KINDS = ("words", "pairs", "triples")


def level_of(count: np.ndarray) -> np.ndarray:
    return np.clip(1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64), 1, LEVELS - 1)


_q = np.arange(1, LEVELS)
#: The least, greatest and middle count of a level.
LEAST_OF = np.concatenate([[0.0], np.ceil(BASE ** (_q - 1.0) - 1e-9)])
MOST_OF = np.concatenate([[0.0], np.maximum(np.ceil(BASE**_q - 1e-9) - 1, LEAST_OF[1:])])
COUNT_OF = (LEAST_OF + MOST_OF) / 2


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the sum of each one's counts."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(c[order], first)


def stream(words: WordHasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(text of each token, (token, pair, triple that end there)) over a block; each text ends with END."""
    h, doc = words(data, offsets)
    n = len(offsets) - 1
    ends = np.cumsum(np.bincount(doc, minlength=n))
    tokens = np.insert(h, ends, END)
    doc = np.insert(doc, ends, np.arange(n))
    first = np.concatenate([[0], (ends + np.arange(1, n + 1))[:-1]])
    one = np.concatenate([[START], tokens[:-1]])
    one[first] = START
    two = np.concatenate([[START], one[:-1]])
    two[first] = START
    pairs = mix(one * np.uint64(0x9FB21C651E98DF25) + tokens)
    triples = mix(pairs * np.uint64(0xC2B2AE3D27D4EB4F) + two)
    return doc, (tokens, pairs & ~np.uint64(0xFFFF), triples & ~np.uint64(0xFFFF))


def small(x: np.ndarray) -> bytes:
    """Whole numbers in the least width that holds them all, after that width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint64)


#: In steps of 32 bits, this stands for a step so long of which the next number is a part.
_FAR = np.uint64((1 << 32) - 1)


def to_steps(h: np.ndarray, short: bool) -> bytes:
    """Sorted hashes of one slice, less its start, as the steps between them; short: without their last two bytes, which are 0, and in
    32 bits."""
    if not short:
        return h.astype("<u8").tobytes()
    far, rest = np.divmod(np.diff(h >> np.uint64(16), prepend=np.uint64(0)), _FAR)
    out = np.full(len(h) + int(far.sum()), _FAR, "<u4")
    out[np.arange(len(h)) + np.cumsum(far).astype(np.int64)] = rest
    return out.tobytes()


def from_steps(raw: bytes, start: np.uint64, short: bool) -> np.ndarray:
    if not short:
        return np.frombuffer(raw, "<u8") + start
    steps = np.frombuffer(raw, "<u4")
    return (np.cumsum(steps, dtype=np.uint64)[steps != _FAR] << np.uint64(16)) + start


def slice_start(slice_: int, slices: int) -> np.uint64:
    return np.uint64(slice_ << (64 - slices.bit_length() + 1)) if slice_ else np.uint64(0)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(64 - slices.bit_length() + 1)).astype(np.int64)


def place(h: np.ndarray, level: int, per: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of a gram at a level, within `per` words, and the bits it sets there."""
    g = mix(h + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    bits = np.zeros(len(g), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((g >> np.uint64(6 * k)) & np.uint64(63))
    return ((g >> np.uint64(32)) % np.asarray(per, np.uint64)).astype(np.int64), bits


def filled(grams: list[tuple[np.ndarray, np.ndarray]], room: int = ROOM) -> np.ndarray:
    """The filter of (hashes, levels): as many words as its entries need, 4 at least."""
    entries = int(sum(lv.sum() for _, lv in grams))
    out = np.zeros(max(4, -(-entries * room // 64)), np.uint64)
    for h, lv in grams:
        for level in range(1, int(lv.max(initial=0)) + 1):
            word, bits = place(h[lv >= level], level, len(out))
            np.bitwise_or.at(out, word, bits)
    return out


def probe(filter_: np.ndarray, h: np.ndarray, start: np.ndarray | int = 0, per: np.ndarray | int | None = None) -> np.ndarray:
    """The levels that the filter has of grams: probe level after level up to the first that is missing.  Parts of the
    filter are told apart by where they start and their number of words."""
    found = np.zeros(len(h), np.uint8)
    live = np.arange(len(h))
    start, per = (np.broadcast_to(x, len(h)) for x in (start, len(filter_) if per is None else per))
    for level in range(1, LEVELS):
        word, bits = place(h[live], level, per[live])
        live = live[(filter_[start[live] + word] & bits) == bits]
        if not len(live):
            break
        found[live] = level
    return found


def packed(batch: pa.RecordBatch) -> bytes:
    """A block of texts as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def squeezed(x: np.ndarray) -> bytes:
    raw = small(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def spread(raw: bytes) -> np.ndarray:
    return whole(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True))


def blocks_of(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows in blocks of about block_bytes of text (one text at least), each with the key of its first row."""
    held, size = [], 0

    def block() -> tuple[int, pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return rows.column("key")[0].as_py(), rows

    for batch in batches:
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + block_bytes - size, side="right")) - 1
            to = min(batch.num_rows, max(at if held else at + 1, to))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
            if to < batch.num_rows:
                yield block()
                held, size = [], 0
                give_back()
            at = to
    if held:
        yield block()


def blocked(source: DataFrame, block_bytes: int) -> DataFrame:
    """(block, rows): the texts of `source` in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in blocks_of(batches, block_bytes):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "rows": pa.array([packed(rows)], pa.binary())})

    return source.mapInArrow(run, "block long, rows binary")


def unblocked(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of blocked(), or those that blocked() would make of rows."""
    first = next(batches, None)
    if first is None:
        return
    batches = itertools.chain([first], batches)
    if "rows" not in first.schema.names:
        yield from blocks_of(batches, block_bytes)
        return
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
            yield block, pa.ipc.open_stream(raw.as_py()).read_next_batch()


DEALT = "slice int, block long, " + ", ".join(f"{k} binary, n_{k} binary" for k in KINDS)


def dealt(texts: DataFrame, slices: int, block_bytes: int) -> DataFrame:
    """The distinct grams of each block, slice by slice, with how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, edges = WordHasher(), np.arange(slices)
        for block, part in unblocked(batches, block_bytes):
            doc, grams = stream(words, *text_buffer(part.column("text")))
            learnt = (~part.column("held_out").to_numpy(zero_copy_only=False)).astype(np.int64)[doc]
            own = [summed(h, learnt) for h in grams]
            del doc, grams, learnt
            cuts = [np.append(np.searchsorted(slice_of(h, slices), edges), len(h)) for h, _ in own]
            for at in range(0, slices, 256):
                out: dict[str, list] = {k: [] for x in KINDS for k in (x, f"n_{x}")}
                some = [s for s in range(at, min(slices, at + 256)) if any(c[s] < c[s + 1] for c in cuts)]
                for s in some:
                    start = slice_start(s, slices)
                    for k, (h, c), e in zip(KINDS, own, cuts, strict=True):
                        out[k].append(to_steps(h[e[s] : e[s + 1]] - start, k != "words"))
                        out[f"n_{k}"].append(squeezed(c[e[s] : e[s + 1]]))
                yield pa.RecordBatch.from_pydict({"slice": pa.array(some, pa.int32()), "block": pa.array([block] * len(some), pa.int64())} | {k: pa.array(v, pa.binary()) for k, v in out.items()})

    return texts.mapInArrow(run, DEALT)


def gathered(t: pa.Table, slices: int, room: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Of one slice: its part of the filter, and for each kind of gram its distinct hashes, their counts, and for each row of t in
    turn where its hashes stand among these, and where its share ends."""
    start = slice_start(t.column("slice")[0].as_py(), slices)
    kinds = []
    for k in KINDS:
        own = [from_steps(raw, start, k != "words") for raw in t.column(k).to_pylist()]
        counts = np.concatenate([spread(raw) for raw in t.column(f"n_{k}").to_pylist()]).astype(np.int64)
        h, at = np.unique(np.concatenate(own), return_inverse=True)
        kinds.append((h, np.bincount(at, counts, len(h)).astype(np.int64), at, np.cumsum([len(x) for x in own])))
    return filled([(h[c > 0], level_of(c[c > 0])) for h, c, _, _ in kinds], room), kinds


STATS = "tokens long, types long, mass double"


def stats_of(counts: np.ndarray) -> tuple[int, int, float]:
    """Of a slice's words: tokens, types, and the tokens as the filter has them."""
    known = counts[counts > 0]
    return int(known.sum()), len(known), float(COUNT_OF[level_of(known)].sum())


def parts(rows: DataFrame, slices: int, room: int) -> DataFrame:
    """(slice, filter, words, counts) and statistics: the parts of the filter, for the broadcast."""

    def join(t: pa.Table) -> pa.Table:
        filter_, kinds = gathered(t, slices, room)
        h, c = kinds[0][0], kinds[0][1]
        tokens, types, mass = stats_of(c)
        row = {"slice": [t.column("slice")[0].as_py()], "filter": [filter_.tobytes()], "words": [h[c > 0].tobytes()], "counts": [c[c > 0].tobytes()], "tokens": [tokens], "types": [types], "mass": [mass]}
        kinds_ = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({k: pa.array(v, x) for (k, v), x in zip(row.items(), kinds_, strict=True)})

    return rows.groupBy("slice").applyInArrow(join, f"slice int, filter binary, words binary, counts binary, {STATS}")


ANSWERS = "block long, slice int, counts binary, words binary, pairs binary, triples binary"


def answers(rows: DataFrame, slices: int, room: int) -> DataFrame:
    """For each row its block's exact counts of words and the filter's levels of all grams, in the order of the hashes; the first
    row of a slice has the slice's statistics too."""

    def answer(t: pa.Table) -> pa.Table:
        filter_, kinds = gathered(t, slices, room)
        found = [probe(filter_, h) for h, _, _, _ in kinds]
        told = [(kinds[0][1], kinds[0])] + list(zip(found, kinds, strict=True))
        out = [[squeezed(x) for x in np.split(values[at], ends[:-1])] for values, (_, _, at, ends) in told]
        names = ("counts", *KINDS)
        data = {"block": t.column("block"), "slice": t.column("slice")} | {k: pa.array(v, pa.binary()) for k, v in zip(names, out, strict=True)}
        for k, v, kind in zip(("tokens", "types", "mass"), stats_of(kinds[0][1]), (pa.int64(), pa.int64(), pa.float64()), strict=True):
            data[k] = pa.array([v] + [0] * (t.num_rows - 1), kind)
        return pa.table(data)

    return rows.groupBy("slice").applyInArrow(answer, f"{ANSWERS}, {STATS}")


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None, small_bytes: int = 32 << 20, head_words: int = 1 << 20, block_bytes: int = 6 << 20, trust: tuple[float, float] = (300.0, 4.0), room: int = ROOM) -> DataFrame:
    """id, held_out (learn is not true), n_tokens, n_known, train_tokens, base_score, score; a row a document.

    small_bytes and head_words bound what is broadcast (at most twice small_bytes, and 16 bytes a word), not what the model holds.
    There is a slice for every 4 MB of text, 2^18 at most; trust is that of one and of two
    words before, room the bits of the filter for each entry.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    source = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), (~F.coalesce(learn, F.lit(False))).alias("held_out"), text)
    texts = source
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():  # else a scan, which gives the same blocks each time
        texts = cut(blocked(source, block_bytes))
    size = source.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = slices or min(1 << 18, max(64, 1 << max(0, (size >> 22) - 1).bit_length()))
    rows = dealt(texts, slices, block_bytes)
    schema = f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rated(part: pa.RecordBatch, doc: np.ndarray, of: list[np.ndarray], exact: np.ndarray, levels: list[np.ndarray], stats: tuple[int, int, float, int]) -> pa.RecordBatch:
        """A block's rows from the exact counts of its distinct words and the levels of its distinct grams."""
        n, v, mass, n_docs = stats
        k = part.num_rows
        words, pairs, triples = (x[i] for x, i in zip(levels, of, strict=True))
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        counts = exact[of[0]]
        before = np.concatenate([[0], counts[:-1]]).astype(np.float64)
        before_two = np.concatenate([[0.0], MOST_OF[pairs[:-1]]])
        before[first] = before_two[first] = n_docs
        p = (COUNT_OF[words] + 1) / (mass + v + 1)
        for level, context, t in ((pairs, before, trust[0]), (triples, before_two, trust[1])):
            share = context / (context + t)
            p = share * np.minimum(1.0, np.maximum(LEAST_OF[level] - DISCOUNT, 0) / np.maximum(context, 1)) + (1 - share) * p
        base = np.bincount(doc, np.log10(counts + 1.0) - float(np.log10(n + v + 1)), k)
        columns = {
            id_col: part.column("id"),
            "held_out": part.column("held_out"),
            "n_tokens": np.bincount(doc, minlength=k).astype(np.int64),
            "n_known": np.bincount(doc, counts > 0, k).astype(np.int64),
            "train_tokens": np.full(k, n, np.int64),
            "base_score": base,
            "score": np.bincount(doc, np.log10(np.minimum(p, 1.0)), k),
        }
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns.values()], list(columns))

    def taken_apart(part: pa.RecordBatch, words: WordHasher) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The text of each token, the distinct grams of each kind in order, and where each token's are among them."""
        doc, grams = stream(words, *text_buffer(part.column("text")))
        distinct, of = zip(*(np.unique(h, return_inverse=True) for h in grams), strict=True)
        return doc, distinct, of

    def broadcast_model() -> DataFrame | None:
        """The scores by a broadcast filter, unless there are more than head_words words."""
        found = sorted(cut(parts(rows, slices, room)).toLocalIterator(), key=lambda r: r["slice"])  # at most small_bytes * 2 in all
        v = sum(r["types"] for r in found)
        if v > head_words:
            return None
        per = np.ones(slices, np.int64)
        for r in found:
            per[r["slice"]] = len(r["filter"]) // 8
        filter_ = np.zeros(int(per.sum()), np.uint64)
        starts = np.cumsum(per) - per
        for r in found:
            filter_[starts[r["slice"]] :][: per[r["slice"]]] = np.frombuffer(r["filter"], np.uint64)
        known = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["words"], np.uint64) for r in found)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in found)])
        n_docs = int(counts[known == END].sum())
        sent = spark.sparkContext.broadcast((filter_, starts, per, known, counts, (sum(r["tokens"] for r in found), v, sum(r["mass"] for r in found), n_docs)))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_, starts, per, known, counts, stats = sent.value
            words = WordHasher()
            for _, part in unblocked(batches, block_bytes):
                doc, distinct, of = taken_apart(part, words)
                slice_ = [slice_of(h, slices) for h in distinct]
                levels = [probe(filter_, h, starts[s], per[s]) for h, s in zip(distinct, slice_, strict=True)]
                exact = np.zeros(len(distinct[0]), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, distinct[0]), len(known) - 1)
                    exact = np.where(known[at] == distinct[0], counts[at], 0)
                yield rated(part, doc, of, exact, levels, stats)

        return texts.mapInArrow(apply, schema)

    if size <= small_bytes:
        scored = broadcast_model()
        if scored is not None:
            return scored
    told = cut(answers(rows, slices, room))
    n, v, mass = (x or 0 for x in told.agg(F.sum("tokens"), F.sum("types"), F.sum("mass")).first())
    n_docs = source.filter("not held_out").count()

    def regain(own: pa.Table, answered: pa.Table) -> pa.Table:
        part = pa.ipc.open_stream(own.column("rows")[0].as_py()).read_next_batch()
        doc, distinct, of = taken_apart(part, WordHasher())
        answered = answered.sort_by("slice")
        exact, *levels = (np.concatenate([spread(x) for x in answered.column(k).to_pylist()]) for k in ("counts", *KINDS))
        if [len(x) for x in levels] != [len(h) for h in distinct]:
            raise ValueError("a block has not got all its answers")
        return pa.Table.from_batches([rated(part, doc, of, exact.astype(np.int64), levels, (n, v, mass, n_docs))])

    asked = told.select("block", "slice", "counts", *KINDS)
    held = texts if texts is not source else blocked(source, block_bytes)
    return held.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(regain, schema)
