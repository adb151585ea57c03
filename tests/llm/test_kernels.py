"""Array kernels against plain Python, on generated input."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphquarry.llm import fingerprint, lm, media, neardup, packing
from graphquarry.llm.common import WordHasher, blocks, text_buffer

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB éß\t\n\x0b\x0c\r\x1c#", max_size=40)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_word_hashes_follow_split(texts):
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    h, doc = WordHasher()(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert doc.tolist() == [i for i, _ in want]
    seen = {}
    for x, (_, w) in zip(h.tolist(), want, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@given(TEXTS, st.integers(1, 30))
@settings(max_examples=80, deadline=None)
def test_blocks_keep_every_text(texts, most):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = [data[a:b].tobytes() for _, data, offsets in blocks(batch, "text", most) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [(t or "").encode() for t in texts]
    sliced = batch.slice(1)
    assert [text_buffer(sliced.column(0))[0].tobytes()] == ["".join(t or "" for t in texts[1:]).encode()]


@given(st.lists(st.lists(st.sampled_from("abcdefg"), max_size=12), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_shingles_and_keys(texts):
    data, offsets = text_buffer(pa.array([" ".join(t) for t in texts]))
    h, doc = WordHasher()(data, offsets)
    d, s, times = neardup.shingles(h, doc, len(texts))
    k1, k2 = neardup.content_keys(h, doc, len(texts))
    for i, t in enumerate(texts):
        want = [tuple(t[k : k + 5]) for k in range(len(t) - 4)] or ([tuple(t)] if t else [])
        assert int((d == i).sum()) == len(set(want)) and int(times[d == i].sum()) == len(want)
        for j, u in enumerate(texts):
            assert ((k1[i], k2[i]) == (k1[j], k2[j])) == (t == u)


@given(st.lists(st.integers(1, 40), min_size=1, max_size=400))
@settings(max_examples=60, deadline=None)
def test_levels_bound_counts(counts):
    c = np.array(counts)
    got = lm.COUNT_OF[lm.level_of(c)]
    assert (np.abs(got - c) <= 0.25 * c + 0.5).all()


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(raw):
    file, row = media.describe(raw)
    payload = media.from_wav(file)
    assert payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {255} and len(payload) % 576 == 0 and len(payload) > 0
    assert row["payload_bytes"] == len(payload) and media.describe(raw)[1]["feature"] == row["feature"]


@given(st.lists(st.binary(max_size=400), min_size=1, max_size=4), st.binary(max_size=400))
@settings(max_examples=60, deadline=None)
def test_fingerprints_do_not_depend_on_their_neighbours(texts, first):
    alone = [fingerprint.to_string(fingerprint.digests([t])[0]) for t in texts]
    together = [fingerprint.to_string(c) for c in fingerprint.digests([first, *texts])[1:]]
    assert alone == together


@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 9)), min_size=1, max_size=12), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_bounds_cover_all_lengths(pairs, buckets):
    by = {}
    for n, c in pairs:
        by[n] = by.get(n, 0) + c
    lengths = np.array(sorted(by), float)
    counts = np.array([by[int(n)] for n in lengths], float)
    bounds = packing.best_bounds(lengths, counts, lengths * counts, buckets)
    assert bounds == sorted(set(bounds)) and bounds[-1] == lengths[-1] and len(bounds) == min(buckets, len(lengths))
