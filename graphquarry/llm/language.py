"""Language ID: a byte convolutional network (filters of several widths, max pooling, softmax), trained in numpy.

The network sees one-hot bytes, so a filter of width w is w tables of 256 weights a channel.  Training takes a
bounded, hash-chosen sample of labelled texts; prediction reads every fixed-length window of every whole text
and averages the windows' log-probabilities, weighted by the bytes they cover.

A null text, or one without a letter, is `und` with score 0.  With no labelled text at all every document is
`und`; with one label only, every other text gets that label.  Ties go to the label that sorts first.  Repeated
rows get equal results; an empty table gives an empty table.  Columns of the input keep their names and values; a
result whose name one of them has gets the name with _1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, crc_mod, free

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 8
UND = "und"
#: The most characters of text that a sample holds, by default.
SAMPLE_CHARS = 64 << 20


@dataclass
class ByteCNN:
    labels: list[str]
    taps: list[np.ndarray]  # by offset k: (256, channels of all widths over k)
    bias: np.ndarray
    dense: np.ndarray
    out: np.ndarray

    @property
    def channels(self) -> int:
        return FILTERS * len(WIDTHS)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x: (windows, WINDOW + 3) bytes; the maxima of each channel and where they are."""
        n = x.shape[1] - max(WIDTHS) + 1
        conv = self.taps[0][x[:, :n]]
        for k in range(1, max(WIDTHS)):
            conv += self.taps[k][x[:, k : n + k]]
        where = conv.argmax(axis=1)
        return np.take_along_axis(conv, where[:, None, :], 1)[:, 0, :] + self.bias, where

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For prediction: the taps of two neighbouring bytes summed, so that two look-ups give a convolution."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return pair(self.taps[0], self.taps[1]), pair(self.taps[2], self.taps[3])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def cut_windows(raw: bytes) -> np.ndarray:
    """All windows of one text, zero-padded, each with the three bytes that follow it."""
    n = max(1, -(-len(raw) // WINDOW))
    x = np.zeros(n * WINDOW + max(WIDTHS) - 1, np.uint8)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(x, WINDOW + max(WIDTHS) - 1)[::WINDOW]


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = 900, batch: int = 96, rate: float = 0.01, per_text: int = 4) -> ByteCNN | None:
    """Adam on the cross-entropy of single windows, each label drawn as often as any other."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        w = cut_windows(text.encode())
        w = w[rng.choice(len(w), min(per_text, len(w)), replace=False)]
        xs.append(w)
        ys += [labels.index(lang)] * len(w)
    x, y = np.concatenate(xs), np.array(ys)
    by = [np.flatnonzero(y == k) for k in range(len(labels))]
    c, m = FILTERS * len(WIDTHS), max(WIDTHS)
    reach = np.repeat(WIDTHS, FILTERS)  # width of each channel
    mask = [(reach > k).astype(np.float32) for k in range(m)]
    net = ByteCNN(labels, [rng.normal(0, 0.3, (256, c)).astype(np.float32) * mask[k] for k in range(m)], np.zeros(c, np.float32), rng.normal(0, 0.3, (c, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    params = [*net.taps, net.bias, net.dense, net.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        rows = np.concatenate([rng.choice(i, max(1, batch // len(labels))) for i in by])
        xb, yb = x[rows], y[rows]
        pooled, where = net.pooled(xb)
        act = np.maximum(pooled, 0)
        p = softmax(act @ net.dense + net.out)
        p[np.arange(len(yb)), yb] -= 1
        p /= len(yb)
        back = (p @ net.dense.T) * (pooled > 0)
        grads = []
        for k in range(m):
            g = np.zeros_like(net.taps[k])
            np.add.at(g, (np.take_along_axis(xb, where + k, 1), np.arange(c)[None, :]), back)
            grads.append(g * mask[k])
        grads += [back.sum(0), act.T @ p, p.sum(0)]
        for i, (w, g) in enumerate(zip(params, grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w -= rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return net


def sample(docs: DataFrame, per_label: int, id_col: str, text_col: str, lang_col: str, most_chars: int | None = None) -> tuple[list[str], list[str]]:
    """The per_label texts of each label that come first by a hash of the id, at every size; of rows that repeat an id the least text.

    Ids are cut before texts are read.  A label's texts that no longer fit its part of most_chars (SAMPLE_CHARS if not given)
    are passed over; its first is taken in any case, up to that length.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(F.col(id_col), 5) != 0))
    ids = known.select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), F.lit(11)).alias("h"))
    first = ids.withColumn("n", F.row_number().over(W.partitionBy("l").orderBy("h"))).filter(F.col("n") <= per_label)
    bounds = first.groupBy("l").agg(F.max("h").alias("last")).collect()
    if not bounds:
        return [], []
    most = max(WINDOW, (most_chars or SAMPLE_CHARS) // len(bounds))
    last = F.create_map(*[F.lit(v) for r in bounds for v in (r.l, r.last)])
    chosen = known.select(F.col(lang_col).alias("l"), F.xxhash64(F.col(id_col), F.lit(11)).alias("h"), F.substring(F.col(text_col).cast("string"), 1, most).alias("t")).filter(F.col("h") <= last[F.col("l")])
    texts, langs, seen, held = [], [], dict.fromkeys((r.l for r in bounds), 0), dict.fromkeys((r.l for r in bounds), 0)
    one = chosen.groupBy("l", "h").agg(F.min("t").alias("t"))  # an id's rows are one text
    for r in one.orderBy("h", "t").toLocalIterator():
        if seen[r.l] == per_label or (seen[r.l] and held[r.l] + len(r.t) > most):
            continue
        seen[r.l] += 1
        held[r.l] += len(r.t)
        texts.append(r.t)
        langs.append(r.l)
    return texts, langs


def window_scores(net: ByteCNN, tables: tuple[np.ndarray, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean log-probability of each label for each text of a block, over all its windows."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // WINDOW))
    doc = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    lo = offsets[:-1][doc] + at * WINDOW
    cover = np.minimum(WINDOW, offsets[1:][doc] - lo)
    total = np.zeros((len(sizes), len(net.labels)))
    m = WINDOW + max(WIDTHS) - 1
    padded = np.concatenate([data, np.zeros(m, np.uint8)])
    for i in range(0, len(doc), 512):
        d, a = doc[i : i + 512], lo[i : i + 512]
        left = offsets[1:][d] - a
        x = np.lib.stride_tricks.sliding_window_view(padded, m)[a]
        short = left < m
        if short.any():
            x[short] = np.where(np.arange(m)[None, :] < left[short, None], x[short], 0)
        two = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        conv = tables[0][two[:, : WINDOW]]
        conv += tables[1][two[:, 2 : WINDOW + 2]]
        act = np.maximum(conv.max(axis=1) + net.bias, 0)
        logp = np.log(softmax(act @ net.dense + net.out) + 1e-9)
        np.add.at(total, d, logp * cover[i : i + 512, None])
    return total / np.maximum(1, sizes)[:, None]


def identify(docs: DataFrame, net: ByteCNN | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; only texts go to Python, and there is no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("lang string, score double")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = sent.value
        tables = net.tables() if net else None
        for column in columns:
            preds, scores = [], []
            for part, data, offsets in blocks(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                n = part.num_rows
                if net is None:
                    preds += [UND] * n
                    scores.append(np.zeros(n))
                    continue
                letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\pL"), False).to_numpy(zero_copy_only=False)
                p = softmax(window_scores(net, tables, data, offsets))
                best = p.argmax(axis=1)
                preds += np.where(letters, np.array(net.labels, object)[best], UND).tolist()
                scores.append(np.where(letters, p[np.arange(n), best], 0.0))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], ["lang", "score"])
            pa.default_memory_pool().release_unused()

    found = free("language_found", docs.columns)
    out = docs.withColumn(found, label(F.col(f"`{text_col}`").cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(found)["lang"].alias(free(pred, docs.columns)), F.col(found)["score"].alias(free(score, docs.columns)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 400, keep: tuple[str, ...] = (), pred: str = "lang_pred", score: str = "score", sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """id_col, the columns `keep`, pred and score of all of docs, after training on a bounded sample of them
    (per_label texts of each label, ids with crc32 mod 5 <> 0, sample_chars characters in all; up to four windows of each)."""
    net = train(*sample(docs, per_label, id_col, text_col, lang_col, sample_chars))
    own = list(dict.fromkeys((id_col, *keep)))
    text = free("text", (*own, pred, score))
    wide = identify(docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{text_col}`").alias(text)), net, text, pred, score)
    return wide.drop(text)
