"""Alignment of two tokenizers over a corpus, by segments that are tokenised once.

A text with a space before it is cut before each run of white space that begins with a space, stands between two other characters, and
follows a character after which no entry of either vocabulary goes on with a space (both vocabularies are read for
that).  No merge crosses such a place, so the tokens of a text are those of its segments, one after the other.

1. Blocks of texts are cut into segments; a block keeps its distinct segments and its texts as places of these.
2. Segments meet by their hash; each distinct one is tokenised and aligned once, and its alignment goes back to the blocks that have it.
   Groups end where tokens of both end, links are pairs of tokens with overlapping bytes.
3. Each block counts the id pairs of its documents, each once a document; Spark adds the counts up.
4. Each block weighs its segments' links by these counts and puts its documents together.

A block is of bounded size (one text at least) and all that a task holds.  Blocks are dealt by a number of their own, so neither ids nor hot segments
make large groups: a block has a segment once, and beyond SPAN partitions of texts a segment is tokenised once for each SPAN of them.

A null or empty text has no tokens, nor has one in which a segment's tokens do not spell its bytes (the second tokenizer reads
U+2581 as a space): zeros, and an empty digest.  Rows that repeat an id count as documents of their own; ids may be null and of any type.  An
empty table gives an empty table.  Only the id of the input's columns is returned, so others may have any name.
"""

from __future__ import annotations

import hashlib
import importlib
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, written

#: Characters and rows of a block.
BLOCK_TEXT, BLOCK_DOCS = 24 << 20, 65536
#: Equal segments meet within so many partitions of texts, each span's in so many parts.
SPAN, PARTS = 256, 512
#: Counts of so many id pairs are broadcast (17 bytes each); more are joined to the blocks that have them.
BROADCAST_PAIRS = 2 << 20
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
_CODEC = "zstd"


def vocabulary_files() -> tuple[str, str]:
    """Where the two tokenizers are installed."""
    at = importlib.import_module("public_tokenizers")
    return at.path(A_FILE), at.path(B_FILE)


def byte_of_char() -> dict[str, int]:
    """The bytes behind the characters of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def unsafe_after(a_tokens: list[bytes], pieces: list[str]) -> frozenset[str]:
    """Characters other than white space after which an entry of either vocabulary goes on with a space."""
    out = {p[i - 1] for p in pieces for i in range(1, len(p)) if p[i] in " ▁"}
    for t in a_tokens:
        for m in re.finditer(rb"[^\x20](?=\x20)", t):
            before = t[: m.end()].decode(errors="replace")[-1]  # half a character makes all that end so unsafe
            out |= {before}
    return frozenset(c for c in out if not c.isspace() and c != "▁")


class Pair:
    """Both tokenizers, in the process that made it."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = byte_of_char()
        vocabulary = self.a.get_vocab()
        self.a_bytes = {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocabulary.items()}
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [piece_bytes(p) for p in self.pieces]
        self.a_sizes = np.zeros(max(self.a_bytes, default=0) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)

    def split_at(self) -> tuple[str, str]:
        """Where texts are cut, and what a text has in which not every space is such a place."""
        bad = "".join(map(re.escape, sorted(unsafe_after(list(self.a_bytes.values()), self.pieces))))
        return rf"(?<=[^\s{bad}]) (?=\s*\S)", rf"^ |[\s{bad}] |\s\Z"

    def valid(self, segment: str, a: list[int], b: list[int]) -> bool:
        """Whether both spell the space and the segment."""
        spelt = (" " + segment).encode()
        return b"".join([self.a_bytes[i] for i in a]) == spelt and b"".join([self.b_bytes[i] for i in b]) == spelt

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment, without the space before it, by either tokenizer; none where one does not spell it."""
        a = [x.ids for x in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        b = self.b.encode(segments, num_threads=1)
        good = [self.valid(s, x, y) for s, x, y in zip(segments, a, b, strict=True)]
        return [x if ok else [] for x, ok in zip(a, good, strict=True)], [x if ok else [] for x, ok in zip(b, good, strict=True)]


def pair_of(files: dict) -> Pair:
    """The tokenizers of broadcast file contents; a worker that has them makes these once, for all its tasks."""
    if "pair" not in files:
        files["pair"] = Pair(files["a"], files["b"])
    return files["pair"]


#: What is known of the tokens of segments, one after the other: n_a, n_b are the tokens of each segment (none: it is not valid), a, b their ids;
#: links: how many B tokens each A token overlaps; shared: whether the first of these is the last one of the A token before it.
FIELDS = ("n_a", "n_b", "a", "b", "links", "shared")


def aligned(a: list[list[int]], b: list[list[int]], a_sizes: np.ndarray, b_sizes: np.ndarray) -> dict[str, np.ndarray]:
    """FIELDS of segments whose tokens spell the same bytes."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
    flat = [np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b)]
    ends = [np.cumsum(sizes[x]) for sizes, x in zip((a_sizes, b_sizes), flat, strict=True)]
    starts = [e - sizes[x] for e, sizes, x in zip(ends, (a_sizes, b_sizes), flat, strict=True)]
    # B tokens that overlap an A token are next to each other
    first, last = np.searchsorted(ends[1], starts[0], side="right"), np.searchsorted(starts[1], ends[0], side="left")
    return {"n_a": n_a, "n_b": n_b, "a": flat[0], "b": flat[1], "links": last - first, "shared": np.concatenate([[False], first[1:] < last[:-1]])[: len(first)]}


def packed(*lists: np.ndarray) -> bytes:
    """Lists of whole numbers under 2^31, their bytes by significance, compressed."""
    raw = b"".join(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in lists)
    return np.array([len(x) for x in lists], "<i8").tobytes() + pa.Codec(_CODEC).compress(raw, asbytes=True)


def unpacked(data: bytes, lists: int = 1) -> list[np.ndarray]:
    sizes = np.frombuffer(data[: 8 * lists], "<i8")
    raw = np.frombuffer(pa.Codec(_CODEC).decompress(data[8 * lists :], int(sizes.sum()) * 4, asbytes=True), np.uint8)
    ends = np.cumsum(sizes) * 4
    return [np.ascontiguousarray(raw[e - 4 * n : e].reshape(4, n).T).view("<i4").reshape(n) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def packed_texts(texts: list[str]) -> bytes:
    raw = [t.encode() for t in texts]
    sizes, whole = packed(np.array([len(x) for x in raw])), b"".join(raw)
    return b"".join([len(sizes).to_bytes(8, "little"), sizes, len(whole).to_bytes(8, "little"), pa.Codec(_CODEC).compress(whole, asbytes=True)])


def unpacked_texts(data: bytes) -> list[str]:
    at = 8 + int.from_bytes(data[:8], "little")
    (sizes,) = unpacked(data[8:at])
    whole = pa.Codec(_CODEC).decompress(data[at + 8 :], int.from_bytes(data[at : at + 8], "little"), asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [whole[x:y].decode() for x, y in zip([0, *ends], ends, strict=False)]


def blocks_of(docs: DataFrame, split: Broadcast, block_text: int) -> DataFrame:
    """(block, part, place, segments, ids, sizes, path) of (id, text).

    Part -1 is a block's texts: their ids, the number of segments of each, and the places of these segments.  The others are its
    distinct segments by their hash, without the space before them; place is that of the first.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        at, odd = re.compile(split.value[0]), re.compile(split.value[1])
        ids: list = []
        sizes: list[int] = []
        path: list[np.ndarray] = []
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        held = blocks = 0

        def block() -> Iterator[pa.RecordBatch]:
            number = (partition << 33) + blocks
            names = list(seen)
            part = np.fromiter((zlib.crc32(s.encode()) for s in names), np.int64, len(names)) % PARTS
            order = np.argsort(part, kind="stable")
            place = np.empty(len(names), np.int32)
            place[order] = np.arange(len(names), dtype=np.int32)
            whole = place[np.concatenate(path)] if len(names) else np.zeros(0, np.int32)
            rows = [(number, -1, 0, None, ids, packed(np.array(sizes)), packed(whole))]
            turns = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)] if len(order) else []
            base = partition // SPAN * PARTS
            rows += [(number, base + int(part[order[i]]), i, packed_texts([names[k] for k in order[i:j].tolist()]), None, None, None) for i, j in zip(turns, turns[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                names = [("block", pa.int64()), ("part", pa.int64()), ("place", pa.int32()), ("segments", pa.binary()), ("ids", pa.list_(batch.schema.field("id").type)), ("sizes", pa.binary()), ("path", pa.binary())]
                schema = pa.schema(names)
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    segments = (at.split(t) if odd.search(t) else t.split(" ")) if t else []
                    ids.append(i)
                    sizes.append(len(segments))
                    path.append(np.array([seen[s] for s in segments], np.int32))
                    held += len(t or "")
                    if held >= block_text or len(ids) >= BLOCK_DOCS:
                        yield from block()
                        blocks, ids, sizes, path, held = blocks + 1, [], [], [], 0
                        seen.clear()
            give_back()
        if ids:
            yield from block()

    return docs.mapInArrow(run, f"block long, part long, place int, segments binary, ids array<{kind}>, sizes binary, path binary")


def groups_of_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of each key, from rows sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def noted(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """The batches; kinds gets the type of their ids."""
    for batch in batches:
        kinds[:] = [batch.schema.field("ids").type]
        yield batch


def alignments(segments: DataFrame, files: Broadcast) -> DataFrame:
    """(block, place, known): FIELDS of the segments of each row (block, part, place, segments), distinct ones of a part made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(files.value)
        for rows in groups_of_rows(batches, "part"):
            place: defaultdict[str, int] = defaultdict()
            place.default_factory = place.__len__
            wanted = [np.array([place[s] for s in unpacked_texts(r["segments"])], np.int64) for r in rows]
            names = list(place)
            parts = [aligned(*pair.tokens(names[i : i + 4096]), pair.a_sizes, pair.b_sizes) for i in range(0, len(names), 4096)]
            known = {f: np.concatenate([x[f] for x in parts]) for f in FIELDS}
            ends = {n: np.concatenate([[0], np.cumsum(known[n])]) for n in ("n_a", "n_b")}
            out = [packed(*chosen(known, ends, of).values()) for of in wanted]
            yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"] for r in rows]), "place": pa.array([r["place"] for r in rows], pa.int32()), "known": pa.array(out, pa.binary())})
            give_back()

    return segments.repartition("part").sortWithinPartitions("part").mapInArrow(run, "block long, place int, known binary")


def chosen(known: dict[str, np.ndarray], ends: dict[str, np.ndarray], of: np.ndarray) -> dict[str, np.ndarray]:
    """FIELDS of these segments, in this order."""
    out = {n: known[n][of] for n in ("n_a", "n_b")}
    at = {}
    for n, k in out.items():
        at[n] = np.repeat(ends[n][of] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    return out | {f: known[f][at["n_b" if f == "b" else "n_a"]] for f in FIELDS if f not in out}


class Block:
    """A block's documents and the alignments of its distinct segments."""

    def __init__(self, ids: list, sizes: bytes, path: bytes, packs: list[bytes]) -> None:
        self.ids, self.sizes, self.path = ids, unpacked(sizes)[0].astype(np.int64), unpacked(path)[0]
        parts = [unpacked(p, len(FIELDS)) for p in packs]
        k = {f: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int32) for i, f in enumerate(FIELDS)}
        self.n_a, self.n_b = k["n_a"].astype(np.int64), k["n_b"].astype(np.int64)
        self.a, self.b, self.shared = k["a"], k["b"], k["shared"].astype(bool)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.of_a = np.concatenate([[0], np.cumsum(self.n_a)])
        #: The links of all segments, one after the other, and how many each has.
        n = k["links"].astype(np.int64)
        self.last = np.cumsum(n - self.shared) - 1  # the last B token that an A token overlaps
        to = np.repeat(self.last - np.cumsum(n) + 1, n) + np.arange(n.sum())
        self.codes = np.repeat(self.a.astype(np.int64), n) << 32 | self.b[to]
        self.of_link = np.concatenate([[0], np.cumsum(n)])[self.of_a]
        self.n_links = np.diff(self.of_link)
        self.good = self.sizes > 0
        self.good[np.searchsorted(self.bounds, np.flatnonzero(self.n_a[self.path] == 0), side="right") - 1] = False

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(code, documents): in how many documents with tokens an id pair is linked."""
        names, code = np.unique(self.codes, return_inverse=True)
        code = code.astype(np.int32)
        counts = np.zeros(len(names), np.int64)
        at, most = 0, 1 << 20
        while at < len(self.ids):  # some documents at a time, with about a million links at most, or one document
            reach = np.cumsum(self.n_links[self.path[self.bounds[at] : self.bounds[at] + most]])
            to = int(np.searchsorted(self.bounds, self.bounds[at] + np.searchsorted(reach, most, side="right"), side="right")) - 1
            to = min(len(self.ids), max(at + 1, to))
            doc = np.repeat(np.arange(to - at), self.sizes[at:to])
            own = self.good[at:to][doc]
            doc, path = np.divmod(np.unique(doc[own] * len(self.n_links) + self.path[self.bounds[at] : self.bounds[to]][own]), max(1, len(self.n_links)))
            k = self.n_links[path]
            where = np.repeat(self.of_link[path] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            seen = np.unique(np.repeat(doc, k) * len(names) + code[where]) % max(1, len(names))
            counts += np.bincount(seen, minlength=len(names))
            at = to
        return names[counts > 0], counts[counts > 0]

    def ends_group(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a group ends with each A token, each B token."""
        a = np.concatenate([~self.shared[1:], [True]])[: len(self.a)]
        b = np.zeros(len(self.b), bool)
        b[self.last[a]] = True
        return a, b

    def groups(self, many: int = 1 << 15) -> list[bytes]:
        """The groups of each segment as text, made for so many segments at a time."""
        ends, of_b = self.ends_group(), np.concatenate([[0], np.cumsum(self.n_b)])
        out: list[bytes] = []
        for i in range(0, len(self.n_a), many):
            j = min(len(self.n_a), i + many)
            parts = []
            for ids, n, of, end in ((self.a, self.n_a, self.of_a, ends[0]), (self.b, self.n_b, of_b, ends[1])):
                last = end[of[i] : of[j]]
                group = np.cumsum(last) - last  # groups are numbered alike on both sides
                parts.append((group, np.repeat(np.arange(j - i), n[i:j]), ids[of[i] : of[j]], last, np.full(len(last), len(parts))))
            group, segment, ids, last, side = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((side, group))  # tokens of a side stay in order
            segment, ids, last, side = segment[order], ids[order], last[order], side[order]
            ends_segment = np.concatenate([segment[1:] != segment[:-1], [True]])[: len(segment)]
            after = np.where(~last, 0, np.where(side == 0, 1, np.where(ends_segment, 3, 2))).tolist()
            text = "".join([f"{x}{',|;/'[m]}" for x, m in zip(ids.tolist(), after, strict=True)]).encode()
            found = iter(text.split(b"/"))
            out += [next(found) if n else b"" for n in self.n_a[i:j].tolist()]
        return out

    def documents(self, kind: pa.DataType, code: np.ndarray, documents: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        """The result row of each document (ids of this kind), by counts that are sorted by code."""
        at = np.minimum(np.searchsorted(code, self.codes), max(0, len(code) - 1))
        seen = code[at] == self.codes if len(code) else np.zeros(len(at), bool)  # links that only documents without tokens have are not counted
        of = np.repeat(np.arange(len(self.n_links)), self.n_links)[seen]
        weigh = lambda x: np.bincount(of, weights=x[at[seen]], minlength=len(self.n_links)).astype(np.int64)
        n_groups = np.diff(np.concatenate([[0], np.cumsum(self.ends_group()[0])])[self.of_a])
        numbers = np.stack([self.n_a, self.n_b, n_groups, self.n_links, weigh(best), weigh(documents)], 1)
        total = np.zeros((len(self.ids), len(SUMS)), np.int64)
        groups, digests = self.groups(), []
        for i, good in enumerate(self.good.tolist()):
            if good:
                own = self.path[self.bounds[i] : self.bounds[i + 1]]
                total[i] = numbers[own].sum(axis=0)
                digests.append(hashlib.sha256(b";".join([groups[x] for x in own.tolist()])).hexdigest())
            else:
                digests.append("")
        return pa.RecordBatch.from_pydict({"id": pa.array(self.ids, kind), **{c: pa.array(total[:, j].copy()) for j, c in enumerate(SUMS)}, "groups_sha256": pa.array(digests, pa.string())})


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def counted(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(block, code, documents, ids, sizes, path, packs): the pair counts of each block, and a row with all of it (code is null)."""
    kind = texts.schema["ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        for rows in groups_of_rows(noted(batches, kinds), "block"):
            head, packs = rows[0], [r["known"] for r in rows[1:]]
            assert head["place"] == -1, "a block without its texts"
            code, n = Block(head["ids"], head["sizes"], head["path"], packs).pairs()
            schema = pa.schema([("block", pa.int64()), ("code", pa.int64()), ("documents", pa.int64()), ("ids", kinds[0]), ("sizes", pa.binary()), ("path", pa.binary()), ("packs", pa.list_(pa.binary()))])
            yield pa.RecordBatch.from_pydict({"block": [head["block"]], "code": [None], "documents": [None], "ids": [head["ids"]], "sizes": [head["sizes"]], "path": [head["path"]], "packs": [packs]}, schema=schema)
            numbers = {"block": pa.array(np.full(len(code), head["block"])), "code": pa.array(code), "documents": pa.array(n)}
            yield pa.RecordBatch.from_pydict(numbers | {c: pa.nulls(len(code), schema.field(c).type) for c in ("ids", "sizes", "path", "packs")}, schema=schema)
            give_back()

    rows = texts.unionByName(known, allowMissingColumns=True)
    return rows.repartition("block").sortWithinPartitions("block", "place").mapInArrow(run, f"block long, code long, documents long, ids {kind}, sizes binary, path binary, packs array<binary>")


def composed(blocks: DataFrame, kind: str, counts: Broadcast | None) -> DataFrame:
    """The result of rows of blocks; counts are broadcast, or else each block's are in rows (code, documents, best) after its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if counts is not None:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "path", "packs"))).documents(batch.schema.field("ids").type.value_type, *counts.value)
                    give_back()
            return
        kinds: list[pa.DataType] = []
        for rows in groups_of_rows(noted(batches, kinds), "block"):
            head, own = rows[0], np.array([(r["code"], r["documents"], r["best"]) for r in rows[1:]], np.int64).reshape(-1, 3)
            yield Block(head["ids"], head["sizes"], head["path"], head["packs"]).documents(kinds[0].value_type, *own.T)

    return blocks.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string")


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None, b_file: str | None = None, block_text: int = BLOCK_TEXT, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a document.

    a_file is a byte-level vocabulary of the tokenizers library, b_file a model of sentencepiece that puts a space before a text and falls back to bytes; their contents are
    broadcast (a few MB, of fixed size).
    """
    sc = docs.sparkSession.sparkContext
    a_file, b_file = (own or found for own, found in zip((a_file, b_file), (None, None) if a_file and b_file else vocabulary_files(), strict=True))
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        contents = {"a": a.read(), "b": b.read()}
    files, split = sc.broadcast(contents), sc.broadcast(Pair(**contents).split_at())
    kind = docs.schema[id_col].dataType.simpleString()

    rows = written(blocks_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), split, block_text))
    texts = rows.filter("part < 0").select("block", F.lit(-1).alias("place"), "ids", "sizes", "path")
    blocks = written(counted(texts, alignments(rows.filter("part >= 0").select("block", "part", "place", "segments"), files)))
    of_block, whole = blocks.filter("code is not null").select("block", "code", "documents"), blocks.filter("code is null").select("block", "ids", "sizes", "path", "packs")
    counts = of_block.groupBy("code").agg(F.sum("documents").alias("documents")).withColumn("a", F.shiftright("code", 32))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    weights = cut(counts.join(highest, "a").select("code", "documents", (F.col("documents") == F.col("highest")).cast("long").alias("best")))
    if weights.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        found = weights.toArrow()
        code, documents, best = (found.column(c).to_numpy() for c in ("code", "documents", "best"))
        order = np.argsort(code)
        out = composed(whole, kind, sc.broadcast((code[order], documents[order], best[order].astype(np.int8))))
    else:
        own = of_block.select("block", "code").join(weights, "code").select("block", "code", "documents", "best")
        both = whole.unionByName(own, allowMissingColumns=True)
        out = composed(both.repartition("block").sortWithinPartitions("block", F.col("code").asc_nulls_first()), kind, None)
    return out.withColumnRenamed("id", id_col)
