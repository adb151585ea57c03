"""Tokenizer alignment, hard negatives and the trie join against brute force, and on odd input."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import alignment, neardup, negatives, triejoin
from graphquarry.llm.queries import ORACLES, QUERIES

ODD = [None, "", "a  b   c \n d\t e  ", "  lead", " ", "▁x y", "x 　 y  z \x1c q", "<|endoftext|> <s> ok </s>", "word " * 3000, "é ü 漢字 漢字 😀 😀z", "\x00 a", "a\r\n b\r c \r", "x" * 5000, " ".join("ab" * (i % 7) for i in range(400))]


@pytest.fixture(scope="module")
def pair():
    a, b = alignment.vocabulary_files()
    with open(a, encoding="utf-8") as x, open(b, "rb") as y:
        return alignment.Pair(x.read(), y.read())


def aligned_by_brute_force(pair, texts):
    """Whole texts, token by token, without segments."""
    found, documents = {}, Counter()
    for i, t in enumerate(texts):
        if not t:
            continue
        a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
        sides = [[pair.a_bytes[x] for x in a], [pair.b_bytes[x] for x in b]]
        if any(b"".join(s) != (" " + t).encode() for s in sides):
            continue
        spans = []
        for s in sides:
            ends = np.cumsum([len(x) for x in s]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links, at = [], 0
        for x, (u, v) in zip(a, spans[0], strict=True):
            while spans[1][at][1] <= u:
                at += 1
            j = at
            while j < len(b) and spans[1][j][0] < v:
                links.append((x, b[j]))
                j += 1
        groups, p, q = [], 0, 0
        for end in sorted({v for _, v in spans[0]} & {v for _, v in spans[1]}):
            own = [[], []]
            while p < len(a) and spans[0][p][1] <= end:
                own[0].append(str(a[p]))
                p += 1
            while q < len(b) and spans[1][q][1] <= end:
                own[1].append(str(b[q]))
                q += 1
            groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
        found[i] = len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
        documents.update(set(links))
    highest = Counter()
    for (x, _), n in documents.items():
        highest[x] = max(highest[x], n)
    out = []
    for i in range(len(texts)):
        if i in found:
            n_a, n_b, n_groups, links, digest = found[i]
            out.append((i, n_a, n_b, n_groups, len(links), sum(documents[x] == highest[x[0]] for x in links), sum(documents[x] for x in links), digest))
        else:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
    return out


@pytest.mark.parametrize("how", [{}, {"block_text": 30_000, "broadcast_pairs": 10}])
def test_op11(spark, sf_dir, pair, how):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, alignment.align(docs, **how).collect())) == aligned_by_brute_force(pair, texts)


def test_op11_spans_and_ids(spark, monkeypatch, pair):
    monkeypatch.setattr(alignment, "SPAN", 1)
    rows = [("x", "one two one"), ("x", "one two one"), (None, "two three"), ("y", None)]
    out = alignment.align(spark.createDataFrame(rows, "name string, text string").repartition(4), "name").collect()
    want = aligned_by_brute_force(pair, [t for _, t in rows])
    assert sorted(map(repr, [(r.name, *tuple(r)[1:]) for r in out])) == sorted(repr((n, *w[1:])) for (n, _), w in zip(rows, want, strict=True))
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op11_places_that_vocabularies_merge_across(pair):
    assert pair.split_at()[0] == r"(?<=[^\s]) (?=\s*\S)"
    unsafe = alignment.unsafe_after([b"a b", b" c", b"  "], ["x▁y", "▁z", "▁▁", "é▁"])
    assert unsafe == {"a", "x", "é"}


def mined_by_brute_force(rows):
    rows = {i: (v, (label + 1) % 10 if i % 7 == 0 else label) for i, label, v in rows}
    whole = {i: ([int(np.floor(256 * float(x))) for x in v], label) for i, (v, label) in rows.items()}
    out = []
    for a, (v, label) in whole.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (w, _) in whole.items()}
        positives = sorted((i for i, (_, m) in whole.items() if m == label and i != a), key=lambda i: (-score[i], i))[:5]
        others = sorted((i for i, (_, m) in whole.items() if m != label), key=lambda i: (-score[i], i))
        for p in positives:
            found = [i for i in others if 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(found, 1)]
    return sorted(out)


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df, **how):
    return sorted(map(tuple, negatives.hard_negatives(df, **how).select(*NAMES).collect()))


def test_op12(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op12_hard_negatives']})").fetchall())
    got = sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, sf_dir).select(*NAMES).collect()))
    assert got == want and len(got) > 0


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e6])
def test_op12_ties_and_many_digits(spark, monkeypatch, scale):
    """Hot copies of one vector, negative and empty windows; with FEW at 0 every digit is refined."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, 0.5, 1.0]) * scale * rng.random() for _ in range(4)]) for i in range(400)]
    rows += [(i, i % 4, [0.5 * scale, 0.25 * scale, 0.0, 0.1 * scale]) for i in range(400, 900)] + [(i, 9, [0.0] * 4) for i in range(900, 1101)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = mined_by_brute_force(rows)
    assert mined(df) == want and mined(df, block_anchors=3) == want
    monkeypatch.setattr(negatives, "FEW", 0)
    assert mined(df) == want


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0], "x"), (1, 1, [1.0, 2.0], "x"), (2, 2, [0.5, 1.0], None), (3, 2, [0.5, None], "x"), (4, 2, [nan, 1.0], "x"), (5, 2, [inf, 1.0], "x"), (6, None, [0.5, 1.0], "x"), (8, 2, None, "x"), (None, 2, [0.5, 1.0], "x"), (9, 2, [0.5], "x"), (10, 2, [0.5, 1.0, 7.0], "x"), (2, 2, [0.5, 1.0], "x"), (1, 1, [1.0, 2.0], "y")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")
    # vector 0 is relabelled 2 (0 is divisible by 7), so 2, 9 and 10 are its positives and 1 the only row of another label
    got = mined(df)
    assert got == [] or {r[0] for r in got} == {0}
    assert {(r[1], r[3]) for r in got} <= {(p, 1) for p in (2, 9, 10)}
    assert mined(df.limit(0)) == []
    huge = spark.createDataFrame([(0, 1, [1e300, -1e300]), (14, 1, [1e300, 1.0]), (1, 3, [1e299, 0.0]), (2, 2, [1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert {r[0] for r in mined(huge)} <= {0}


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    return out


def joined_by_brute_force(texts):
    sets = sets_of(texts)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sorted(sets.items()):
        common = Counter(j for x in s for j in where.get(x, ()))
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            where.setdefault(x, []).append(i)
    return [(i, len(sets[i]), root(i)) for i in sorted(sets)]


def near_copies(n, seed, words=60, edits=3):
    """Texts that share a passage, and chains of near copies about the threshold."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(55))
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        base = w if rng.random() < 0.2 else base
        kind = i % 4
        out.append((i, " ".join(w) if kind < 2 else passage + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 200))) if kind == 2 else " ".join(w[: rng.randrange(words)])))
    return out


@pytest.mark.parametrize(("seed", "large"), [(1, 64), (2, 2), (3, 8)])
def test_op13(spark, monkeypatch, seed, large):
    texts = near_copies(500, seed) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three four"), (1006, "x " * 30_000), (1007, "x " * 29_000 + "y")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    want = joined_by_brute_force(texts)
    assert sum(a != c for a, _, c in want) > 50
    assert sorted(map(tuple, triejoin.trie_join(df, large_bucket=large).collect())) == want
    monkeypatch.setattr(triejoin, "TILE_SETS", 16)
    assert sorted(map(tuple, triejoin.trie_join(df, large_bucket=large, broadcast_rows=5).collect())) == want


def test_op13_on_the_documents(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_trie_join"](spark, sf_dir).collect())) == joined_by_brute_force(texts)


def test_op13_odd_rows(spark):
    rows = [(3, "a b c d e", 1), (None, "a b c d e", 2), (1, "a b c d e", 3), (1, "q r s t", 4), (2, "q r s t", 5), (7, None, 6), (7, None, 6)]
    out = triejoin.trie_join(spark.createDataFrame(rows, "doc_id long, text string, node int")).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(3, 2, 1), (None, 2, None), (1, 2, 1), (1, 1, 1), (2, 1, 1), (7, 0, 7), (7, 0, 7)]))
    assert triejoin.trie_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tries_find_all_pairs():
    rng = np.random.default_rng(5)
    for trial in range(30):
        base = rng.integers(0, 1 << 62, 80).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(80) < 0.06, rng.integers(0, 1 << 62, 80).astype(np.uint64), base)[: rng.integers(50, 80)]) for _ in range(25)]
        n = np.array([len(s) for s in sets])
        label, tile = np.arange(25), rng.integers(0, 2, 25)
        walkers = np.arange(25) if trial % 2 else np.array([0])
        pairs, found = triejoin.trie_links(sets, n, None, label, tile, trial % 3 > 0, walkers, 85)
        want = set()
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (n[i] + n[j] - both) and (trial % 3 or tile[i] != tile[j]) and (i in walkers or j in walkers):
                    want.add((j, i))
        assert {tuple(sorted(p)) for p in pairs} <= want and set(np.flatnonzero(found)) <= {x for p in want for x in p}
        classes = lambda edges: {frozenset(c) for c in merged(edges)}
        assert classes(pairs) == classes(want)


def merged(edges):
    out = []
    for a, b in edges:
        hit = [c for c in out if a in c or b in c]
        out = [c for c in out if c not in hit] + [set().union({a, b}, *hit)]
    return out


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d", 5, "x"), (2, "a b c d", 6, None)], "doc_id long, text string, n int, block string")
    assert sorted(r.component_id for r in triejoin.trie_join(df).collect()) == [1, 1]
    assert [r.n_a for r in alignment.align(df.withColumn("place", F.lit(1))).collect()] == [4, 4]


def join_rows(df):
    """Rows that each join of a plan made, largest first, once df has run."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in name:
            out.append((node.metrics().apply("numOutputRows").value(), str(node.leftKeys().mkString(","))))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sorted(out, reverse=True)


def test_op5_reads_a_text_once_for_all_its_buckets(spark):
    """Near copies share many buckets; what they have is joined to a row a text, not to a row a text and bucket."""
    n, buckets = 60, 30
    members = spark.createDataFrame([(b, i, i % 3) for i in range(n) for b in range(buckets)], "bucket long, node long, label long")
    own = spark.createDataFrame([(i, 10 * i) for i in range(n)], "node long, m long")
    out = neardup.dealt(members, own, ("m",), 16)
    rows = join_rows(out)
    by_node = [r for r, keys in rows if keys.startswith("node#")]
    assert by_node and max(by_node) == n
    got = {(r.bucket, r.node, r.label, r.m) for r in out.collect()}
    assert got == {(b, i, i % 3, 10 * i) for i in range(n) for b in range(buckets)}
