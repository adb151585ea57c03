"""Media columns: text bytes kept as 8-bit WAV samples, their spectrogram, and peak-pair fingerprints.

Each text becomes one mono WAV file (the wave module writes and reads it).  The samples read back are cut into
overlapping frames, a short-time Fourier transform gives magnitudes, the strongest local peaks of each frame
are paired with peaks of the next frames, and each pair is stored as a hash with the time of its first peak.

Null and empty texts store one frame of padding and have no pairs; equal texts give equal values; a text of any
length is read whole; repeated rows give repeated results; an empty table gives an empty table.  Only the id of the
input's columns is returned, so others may have any name.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer

#: Samples in a frame; payloads are padded to a multiple of it (fixed value of the result contract), with PAD.
FRAME, PAD = 576, 255
RATE = 8000
PEAKS, FAN = 3, 2

SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, times array<int>, pairs array<long>, feature string"
)


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (-len(raw) % FRAME if raw else FRAME)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Frames that one transform takes at most; longer media are transformed piece by piece.
_PIECE = 4096


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame number and frequency bin of the PEAKS strongest local maxima of each frame; ties: lower bins."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    hop = FRAME // 2
    n = max(1, (len(x) - FRAME) // hop + 1)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    at, bins = [], []
    for i in range(0, n, _PIECE):
        mag = np.abs(np.fft.rfft(frames[i : i + _PIECE] * _WINDOW, axis=1))[:, 2:-1].astype(np.float32)
        top = np.zeros_like(mag)
        inner = mag[:, 1:-1]
        top[:, 1:-1] = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]) & (inner > 1e-3), inner, 0)
        best = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
        best.sort(axis=1)
        f, k = np.nonzero(np.take_along_axis(top, best, axis=1) > 0)
        at.append(f + i)
        bins.append(best[f, k] + 2)
    return np.concatenate(at), np.concatenate(bins)


def peak_pairs(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes): each peak with those of the next FAN peaks that lie in later frames."""
    t, f = peaks(samples)
    times, pairs = [], []
    for d in range(1, PEAKS + FAN):
        if len(t) <= d:
            break
        dt = t[d:] - t[:-d]
        ok = (dt > 0) & (dt <= FAN)
        times.append(t[:-d][ok])
        pairs.append((f[:-d][ok] << 20) | (f[d:][ok] << 8) | dt[ok])
    if not times:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    times, pairs = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((pairs, times))
    return times[order], pairs[order]


def describe(raw: bytes) -> tuple[bytes, dict]:
    """The WAV file of one text and what is read back from it."""
    media = to_wav(pad(raw))
    payload = from_wav(media)
    times, pairs = peak_pairs(payload)
    digest = hashlib.md5(times.astype("<i4").tobytes() + pairs.astype("<i8").tobytes()).hexdigest()
    n_frames = (len(payload) - FRAME) // (FRAME // 2) + 1
    return media, {
        "n_bytes": len(raw),
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "n_frames": n_frames,
        "times": times.astype(np.int32),
        "pairs": pairs.astype(np.int64),
        "feature": f"{n_frames}:{len(pairs)}:{digest}",
    }


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """One row a document: its id, the columns of SCHEMA, and the WAV file itself if keep_media.

    No shuffle: each partition is streamed in Arrow batches.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    schema = f"{id_col} {id_type}, {SCHEMA}" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                data, offsets = text_buffer(part.column("text"))
                files, rows = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    media, row = describe(data[a:b].tobytes())
                    rows.append(row)
                    files.append(media if keep_media else None)
                out = {id_col: part.column("id")} | {k: pa.array([r[k] for r in rows]) for k in rows[0]}
                out["times"] = pa.array([r["times"] for r in rows], pa.list_(pa.int32()))
                out["pairs"] = pa.array([r["pairs"] for r in rows], pa.list_(pa.int64()))
                if keep_media:
                    out["media"] = pa.array(files, pa.binary())
                yield pa.RecordBatch.from_pydict(out)
            pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
