"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphquarry.llm import chat, fingerprint, language, licenses, lm, media, mixing, neardup, packing, quality
from graphquarry.llm.common import crc_mod

LONG = "the quick brown fox jumps over the lazy dog again and again " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, n long, rank long, id long"
ROWS = [
    (1, "The one with some words in a row here", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "   \n\t ", "fr", "b"),
    (5, LONG, "en", "a"),
    (6, "ééé ààà la le les une des mots", "fr", "b"),
    (7, "The one with some words in a row here", "en", None),
    (7, "The one with some words in a row here", "en", None),
    (8, "12345 !!! ### 777", "en", "b"),
    (9, "Released under the MIT License.\nSome more.", "en", "b"),
    (None, "no id at all but words", "en", "b"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, None, 0.5, "x", 1, 2, 3) for r in rows], SCHEMA)


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, None), (5, 1, 0), (6, 1, 0), (8, 0, 0), (9, 1, 0), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "licenses": lambda d: licenses.scan(d),
    "lm": lambda d: lm.score(d, crc_mod(F.col("doc_id"), 7) != 2),
    "fingerprint": lambda d: fingerprint.fingerprints(d),
    "mixing": lambda d: mixing.mix(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "packing": lambda d: packing.pack(d),
    "media": lambda d: media.media_columns(d),
    "language": lambda d: language.language_id(d),
    "quality": lambda d: quality.quality(d, labels_of(d.sparkSession)),
}
A_ROW_EACH = set(OPERATORS) - {"mixing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](docs_of(spark, ROWS)).collect()
    if name in A_ROW_EACH:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    else:
        assert {r.doc_id for r in out} <= {r[0] for r in ROWS}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("name", sorted(A_ROW_EACH - {"fingerprint", "packing", "neardup"}))
def test_repeated_rows_are_equal(spark, name):
    a, b = (r for r in OPERATORS[name](docs_of(spark, ROWS)).collect() if r.doc_id == 7)
    assert a == b


def test_defined_results(spark):
    docs = docs_of(spark, ROWS)
    lang = {r.doc_id: r for r in OPERATORS["language"](docs).collect()}
    assert {i for i, r in lang.items() if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert all(r.score == 0 for i, r in lang.items() if r.lang_pred == "und")
    found = {r.doc_id: r for r in OPERATORS["licenses"](docs).collect()}
    assert found[9].matches[0].license == "MIT/notice" and found[9].matches[0].dice == 1.0
    assert found[2].matches == [] and found[2].n_lines == 0
    finger = {r.doc_id: r for r in OPERATORS["fingerprint"](docs).collect()}
    assert finger[2].fingerprint == finger[3].fingerprint == "0:" and finger[2].near_edited == 1.0 and finger[2].near_next == 1.0
    assert finger[1].fingerprint == finger[7].fingerprint
    dup = {r.doc_id: r for r in OPERATORS["neardup"](docs).collect()}
    assert dup[7].class_id == 1 and dup[3].class_id == 2 and dup[4].class_id == 2 and dup[None].kept and dup[None].class_id is None
    packed = OPERATORS["packing"](docs).collect()
    assert {r.bucket for r in packed if r.n_tokens == 0} == {0}
    assert next(r for r in packed if r.doc_id == 5).n_tokens == 240_000
    scores = {r.doc_id: r for r in OPERATORS["lm"](docs).collect()}
    assert scores[2].n_tokens == 1 and scores[5].n_tokens == 240_001


def test_single_label_and_no_labels(spark):
    one = docs_of(spark, [(1, "some words", "en", "a"), (2, "more", "en", "a"), (3, "x", "en", "a"), (4, "y", None, "a")])
    assert {r.lang_pred for r in language.language_id(one).collect()} == {"en"}
    none = docs_of(spark, [(1, "some words", None, "a")])
    assert [(r.lang_pred, r.score) for r in language.language_id(none).collect()] == [("und", 0.0)]
    empty = labels_of(spark).limit(0)
    assert {r.score for r in quality.quality(one, empty).collect()} == {0.5}


CHAT = "conv_id long, turn long, role string, text string, extra string"


def test_chat_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"),  # a start of 1
        (3, 5, "user", "hi"), (3, 9, "assistant", "yes"),  # equal to 1
        (4, 0, None, None), (4, None, "user", ""),
        (5, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"),  # logged twice
        (None, 0, "user", "nobody"),
        (6, 0, "assistant", "yes"), (6, 1, "user", "hi"),  # other order
    ]
    out = {r.conv_id: r for r in chat.chat_format(spark.createDataFrame([(*r, "x") for r in rows], CHAT)).collect()}
    assert set(out) == {1, 4, 5, None, 6}
    assert out[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert out[5].n_turns == 2 and out[4].n_turns == 2
    assert chat.chat_format(spark.createDataFrame([], CHAT)).collect() == []


def test_chat_long_conversations(spark):
    n = 5000
    long = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    start = long.filter("turn < 4500").withColumn("conv_id", F.lit(2).cast("long")).withColumn("turn", F.col("turn") + 7)
    other = start.withColumn("conv_id", F.lit(3).cast("long")).withColumn("text", F.when(F.col("turn") == 4400, "else").otherwise(F.col("text")))
    out = chat.chat_format(long.union(start).union(other)).collect()
    assert {r.conv_id for r in out} == {1, 3}
    whole = "".join(r.rendered for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(n))


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    docs = docs_of(spark, ROWS)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, sf_dir)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            assert out.count() >= 0


def test_names_that_clash_keep_their_values(spark):
    names = ("n_lines", "matches", "scan_norm", "language_found", "lang_pred", "score", "mix_domain", "mix_epoch", "mix_end", "mix_key", "bucket", "n_tokens", "slot", "in_0", "Text_1")
    rows = [(1, "one two three MIT", "en", "a"), (2, "four five six seven", "fr", "b"), (3, "The one with some words", "en", "a")]
    docs = spark.createDataFrame([(*r, *[f"{n} of {r[0]}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    labels = labels_of(spark)
    outs = {
        "licenses": (licenses.scan(docs), {"n_lines_1", "matches_1"}),
        "mixing": (mixing.mix(docs, share=1.0), {"mix_domain_1", "mix_epoch_1"}),
        "language": (language.language_id(docs, keep=names), {"lang_pred_1", "score_1"}),
        "quality": (quality.quality(docs, labels, keep=names), {"score_1"}),
        "packing": (packing.pack(docs, keep=names), {"bucket_1", "n_tokens_1", "slot_1", "bound", "batch"}),
    }
    for name, (out, new) in outs.items():
        assert new <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        got = out.collect()
        assert got and all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names), name


def test_samples_pass_over_texts_that_do_not_fit(spark):
    rows = [(i, "the words of this text " * (4000 if i < 40 else 2), "en", "a") for i in range(80)] + [(100 + i, "les mots de ce texte " * (4000 if i < 40 else 2), "fr", "b") for i in range(80)]
    docs = docs_of(spark, rows)
    for limit in (1000, 20_000, 1 << 20):
        out = {r.doc_id: r for r in language.language_id(docs, sample_chars=limit).collect()}
        assert sum(r.lang_pred == ("en" if i < 100 else "fr") for i, r in out.items()) > 150, limit
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in rows], "doc_id long, quality int")
    texts, kinds, share = quality.sample(docs, labels, 3000, "doc_id", "text", "quality", 20_000)
    assert sum(map(len, texts)) <= 20_000 and 0.3 < share < 0.7 and min(kinds.count(0), kinds.count(1)) >= 10
    assert {r.score > 0.5 for r in quality.quality(docs, labels, sample_bytes=20_000).collect() if r.doc_id < 100} == {True}


def test_fingerprints_of_ids_of_any_type(spark):
    rows = [(f"id {i % 7}" if i % 3 else None, f"text number {i} of some words and then {i * i}") for i in range(90)] + [("same", "same text")] * 12
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    out = {n: sorted(map(repr, fingerprint.fingerprints(docs, range_bytes=n).collect())) for n in (64, 1 << 20)}
    assert out[64] == out[1 << 20] and len(out[64]) == len(rows)
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).collect()
    order.sort(key=lambda r: (r.doc_id is not None, r.doc_id or "", r.key, r.text))
    want = [fingerprint.likeness(*fingerprint.digests([a.text.encode(), b.text.encode()])) for a, b in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(f"{x:.9f}" for x in want) == sorted(f"{r.near_next:.9f}" for r in fingerprint.fingerprints(docs, range_bytes=64).collect())


def test_rows_without_ids_are_spread(spark):
    turns = spark.range(4000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in chat.ordered(turns).groupBy("range").count().collect()]
        assert max(sizes) < 2000
        out = sorted(chat.chat_format(turns.union(turns)).collect(), key=lambda r: r.part)
        assert len(out) == 20 and "".join(r.rendered for r in out) == "".join(f"<|im_start|>user\nt{i:05d}<|im_end|>\n" for i in range(4000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    docs = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    packed = packing.pack(docs).collect()
    assert len({(r.batch, r.slot) for r in packed}) == 300


def test_turns_that_are_no_numbers(spark):
    turns = spark.createDataFrame([("a", "x", "user", "first"), ("a", "1", "user", "second"), ("a", "2", "assistant", "third")], "conv_id string, turn string, role string, text string")
    out = chat.chat_format(turns).collect()
    assert len(out) == 1 and [out[0].asDict()[c] for c in out[0].asDict() if "first" in str(out[0].asDict()[c])]


def test_samples_take_one_text_of_a_repeated_id(spark):
    rows = [(1, f"text {i} of one id", "en", "a") for i in range(500)] + [(i, "le la les des une", "fr", "b") for i in range(2, 60)]
    texts, langs = language.sample(docs_of(spark, rows), 400, "doc_id", "text", "lang")
    assert langs.count("en") == 1 and texts[langs.index("en")] == "text 0 of one id" and langs.count("fr") > 20
    labels = spark.createDataFrame([(1, 1), *[(i, 0) for i in range(2, 60)]], "doc_id long, quality int")
    found, of, _ = quality.sample(docs_of(spark, rows), labels, 100, "doc_id", "text", "quality")
    assert of.count(1) == 1 and found[of.index(1)] == b"text 0 of one id"
