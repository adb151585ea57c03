"""Quality classifier by compression: how much better a dictionary of good texts compresses a text than one of bad texts.

Two zstandard dictionaries are built from a bounded, hash-chosen sample of labelled texts.  A whole text is cut into
chunks, each compressed with both; the difference of the total sizes by the text's size is the only feature, and
a logistic curve, fitted on other labelled texts and shifted from the sample's share of each class to that of all
labels, turns it into the score.

A null or empty text has the feature 0, and so the score of the curve there.  Without labels of both classes the
score is the share of label 1 (0.5 without labels).  Repeated rows get equal scores; an empty table gives an empty table.
Columns of the input keep their names and values; if one of them has the name of the score, that gets the name with _1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, free

CHUNK, LEVEL, DICT_BYTES = 256, 3, 110 << 10
CUT = 0.3
#: The most bytes of text that a sample holds, by default.
SAMPLE_BYTES = 64 << 20


@dataclass
class Model:
    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    slope: float
    offset: float


def build_dictionary(texts: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or where there is too little text for one its raw bytes."""
    pieces = [t[i : i + CHUNK] for t in texts for i in range(0, len(t), CHUNK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICT_BYTES:], False


def compressor(data: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(data, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def gain(raw: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """The normalised difference of compressed sizes; over 0: the good dictionary fits better."""
    if not raw:
        return 0.0
    view = memoryview(raw)
    total = 0
    for i in range(0, len(raw), CHUNK):
        piece = view[i : i + CHUNK]
        total += len(bad.compress(piece)) - len(good.compress(piece))
    return total / (len(raw) + 32)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for a logistic curve with a slight ridge, on the standardised feature."""
    mean, dev = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / dev, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([0.1, 1e-3])
        w += np.linalg.solve(h, z.T @ (y - p) - np.array([0.1, 1e-3]) * w)
    return float(w[0] / dev), float(w[1] - w[0] * mean / dev)


def fit(texts: list[bytes], labels: list[int], prior: float | None = None) -> Model | float:
    """Even rows of each class build the dictionaries, odd ones fit the curve; prior: the share of label 1 in all labels."""
    of = {k: [t for t, v in zip(texts, labels, strict=True) if v == k] for k in (0, 1)}
    if len(of[0]) < 2 or len(of[1]) < 2:
        return float(len(of[1]) / len(labels)) if labels else 0.5
    good, bad = build_dictionary(of[1][::2]), build_dictionary(of[0][::2])
    g, b = compressor(*good), compressor(*bad)
    x = np.array([gain(t, g, b) for k in (0, 1) for t in of[k][1::2]])
    y = np.array([k for k in (0, 1) for _ in of[k][1::2]], float)
    slope, offset = calibrate(x, y)
    if prior is not None and 0 < prior < 1:
        offset += float(np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean())))
    return Model(good[0], bad[0], (good[1], bad[1]), slope, offset)


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int], float | None]:
    """At most per_class labelled ids of each class, by the order of a hash; then their texts, and the share of label 1 in
    all labels.  A class has half of most_bytes: its texts that no longer fit are passed over, its first is taken in any case, up
    to that length.  Of rows that repeat an id the least text counts."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), 5) != 0)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    h = F.xxhash64(F.col(id_col), F.lit(13))
    ids = known.filter("label = 0").orderBy(h, id_col).limit(per_class).unionByName(known.filter("label = 1").orderBy(h, id_col).limit(per_class))
    most = max(1, most_bytes // 2)
    text = F.substring(F.col(text_col).cast("string"), 1, most).alias("text")
    one = docs.select(F.col(id_col), text).join(F.broadcast(ids), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))  # an id's rows are one text
    rows = one.orderBy(F.xxhash64(F.col(id_col), F.lit(17))).toLocalIterator()
    texts, out, held = [], [], {0: 0, 1: 0}
    for r in rows:
        raw = (r.text or "").encode()[:most]
        if held[r.label] and held[r.label] + len(raw) > most:
            continue
        held[r.label] += len(raw)
        texts.append(raw)
        out.append(r.label)
    return texts, out, known.agg(F.avg("label")).first()[0]


def score(docs: DataFrame, model: Model | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the quality score; only texts go to Python, and there is no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def rate(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        if not isinstance(m, float):
            good, bad = compressor(m.good, m.trained[0]), compressor(m.bad, m.trained[1])
        for column in columns:
            scores = [np.zeros(0)]
            for part, data, offsets in blocks(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                if isinstance(m, float):
                    scores.append(np.full(part.num_rows, m))
                    continue
                x = np.array([gain(data[a:b].tobytes(), good, bad) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                scores.append(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30))))
            yield pa.array(np.concatenate(scores), pa.float64())
            pa.default_memory_pool().release_unused()

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], rate(F.col(f"`{text_col}`").cast("string")).alias(free(name, docs.columns)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, keep: tuple[str, ...] = (), name: str = "score", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """id_col, the columns `keep` and the score of all of docs, after learning from a bounded sample of labels
    (per_class ids of each class, crc32 mod 5 <> 0, sample_bytes bytes of text in all)."""
    model = fit(*sample(docs, labels, per_class, id_col, text_col, label_col, sample_bytes))
    own = list(dict.fromkeys((id_col, *keep)))
    text = free("text", (*own, name))
    wide = score(docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").alias(text)), model, text, name)
    return wide.drop(text)
