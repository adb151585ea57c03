"""Helpers that the training-data operators share: tables, checkpoints, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialise import broadcast_within, cut, ensure_checkpoint_dir  # noqa: F401

#: Words are runs of anything but the six ASCII white-space bytes (fixed value of the result contract).
WORD = r"[^\x20\x09-\x0D]+"

#: Python workers cut their batches into blocks of at most this many text bytes (one text at least) and rows.
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Like cut(), but as a compressed table in the same shared folder; it stays there as checkpoints do."""
    ensure_checkpoint_dir(df.sparkSession)
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id written as text, modulo m; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null"))) % m


def free(name: str, taken) -> str:
    """name, or where a column has it (in any case) name_1, name_2 and so on."""
    used = {c.lower() for c in taken}
    return next(x for i in range(len(used) + 1) if (x := name if i == 0 else f"{name}_{i}").lower() not in used)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def blocks(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES):
    """Slices of a record batch whose texts hold about `most` bytes, each with its byte buffer and offsets.

    Texts are laid out BLOCK_ROWS rows at a time, and what is no longer used goes back to the system, since workers
    live on between tasks.
    """
    for start in range(0, batch.num_rows, BLOCK_ROWS):
        rows = batch.slice(start, BLOCK_ROWS)
        data, offsets = text_buffer(rows.column(text))
        at, n = 0, rows.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield rows.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
    give_back()


def give_back() -> None:
    """Return unused memory of Arrow and, where the C library can, of the heap to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class WordHasher:
    """64-bit hashes of all words of a block at once, by differences of one prefix polynomial."""

    def __init__(self) -> None:
        self.p = self.q = np.zeros(0, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of its text), in text order."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.p) < n:
            self.p, self.q = powers(n), powers(n, pow(_BASE, -1, 1 << 64))
        b = _LOWER[data] if lower else data
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = ~_SPACE[b]
        start, end = word.copy(), word.copy()
        start[1:] &= ~word[:-1] | edge[1:n]
        end[:-1] &= ~word[1:] | edge[1:n]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.p[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.q[starts]
        h ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        return mix(h), np.searchsorted(offsets, starts, side="right") - 1
