"""Hybrid retrieval, set at a time: every operator takes many queries at once, keyed by query_id.

Query terms are the small side of the posting join; the posting table is never collected or ranked whole: scores are
aggregated per (query, document), and only the best k of each query leave the ranking window (Spark keeps k rows
a query in each task before the shuffle).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions import words
from ..plans.materialise import broadcast_blocks, broadcast_within, cut

#: Terms, and pairs of a query and a term, that may be broadcast.
SMALL_TERMS = 200_000
#: Postings of a task that scores documents, about.
TASK_POSTINGS = 200_000


def postings(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf): how often each document has each term, or each term of `asked` (term), which then are the only ones that are
    counted and shuffled.  Stop words go after the explode, in compiled code."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.long_words(F.col(text_col))).alias("term")).filter(~F.col("term").isin(words.STOP_WORDS))
    if asked is not None:
        terms = terms.join(_wanted(asked), "term", "left_semi")
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def _wanted(terms: DataFrame) -> DataFrame:
    return broadcast_within(cut(terms.select("term").distinct()), SMALL_TERMS)


def doc_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, doc_len): terms of each document, 0 for those without any.  No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.text_tokens(F.col(text_col))).cast("bigint").alias("doc_len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: n_docs and avgdl, documents without terms included."""
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(T.text_tokens(F.col(text_col)))).alias("term"))


def rounded(score: Column) -> Column:
    return F.round(score, 6)


def bm25(terms: DataFrame, posts: DataFrame, stats: DataFrame, k1: float = schema.BM25_K1, b: float = schema.BM25_B, task_postings: int = TASK_POSTINGS) -> DataFrame:
    """(query_id, doc_id, score): BM25 over each query's distinct terms.

    Postings are first cut down to the terms that any query has; document frequencies are counted on those only, and
    the documents are not tokenised again for them.  Then they are dealt by document, about TASK_POSTINGS a task, and scored where they are,
    so that no row of a query, term and document is shuffled.
    """
    stats = cut(stats)  # narrow: documents are tokenised for their lengths once
    corpus = corpus_stats(stats).first()  # two numbers
    n, avgdl = corpus.n_docs, corpus.avgdl or 1.0
    own = cut(posts.join(_wanted(terms), "term", "left_semi").select("doc_id", "term", "tf"))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").select("query_id", "term", F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    parts = max(own.sparkSession.sparkContext.defaultParallelism, -(-own.count() // task_postings))
    dealt = own.repartition(parts, "doc_id").join(stats.repartition(parts, "doc_id").hint("merge"), "doc_id")
    hits = dealt.join(broadcast_within(cut(weights), SMALL_TERMS), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / avgdl))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """The k best of each query by rounded score, then id; with rank from 1."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scores.withColumn("score", rounded(F.col("score"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_scores(queries: DataFrame, vectors: DataFrame, batch: int = 4000) -> DataFrame:
    """(query_id, doc_id, score): exact cosine of each query vector with every vector.

    Queries go to every task as batches of a checked size, and one pass over the vectors serves a batch; each vector is
    scaled once.
    """
    unit = F.transform("embedding", lambda x: x.cast("double") / F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    v = vectors.select("doc_id", unit.alias("dv"))
    parts = broadcast_blocks(queries.select("query_id", unit.alias("qv")), batch)
    return reduce(DataFrame.unionByName, [v.join(p, F.lit(True)).select("query_id", "doc_id", dot(F.col("qv"), F.col("dv")).alias("score")) for p in parts])


def min_max(scores: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; a constant list becomes 1."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(sparse: DataFrame, dense: DataFrame, dense_weight: float = schema.DENSE_WEIGHT) -> DataFrame:
    """Full outer join of two scaled lists; a missing side counts 0."""
    s = min_max(sparse).select("query_id", "doc_id", F.col("score").alias("s"))
    d = min_max(dense).select("query_id", "doc_id", F.col("score").alias("d"))
    both = s.join(d, ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", ((1 - dense_weight) * F.coalesce("s", F.lit(0.0)) + dense_weight * F.coalesce("d", F.lit(0.0))).alias("score"))


def hybrid(sparse: DataFrame, dense: DataFrame, k: int = schema.TOP_K, dense_weight: float = schema.DENSE_WEIGHT) -> DataFrame:
    """The k best after fusing the k best sparse with the 3k best dense results."""
    cols = ("query_id", "doc_id", "score")
    return top_k(fuse(top_k(sparse, k).select(*cols), top_k(dense, 3 * k).select(*cols), dense_weight), k)


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, size: int = 384) -> DataFrame:
    """(doc_id, slot, value): feature-hashed, signed and L2-normalised term counts, as a sparse table."""
    return posting_vectors(postings(docs, id_col, text_col), size)


def posting_vectors(terms: DataFrame, size: int = 384) -> DataFrame:
    """hashed_vectors() of documents whose postings (doc_id, term, tf) are there.  Slots are dealt by document once, for sums and norms."""
    slot, sign = T.hash_slots(F.col("term"), size)
    slots = terms.select("doc_id", slot.alias("slot"), (sign * F.col("tf")).alias("v")).repartition("doc_id")
    sums = slots.groupBy("doc_id", "slot").agg(F.sum("v").alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("doc_id")))
    return sums.select("doc_id", "slot", (F.col("v") / norm).alias("value"))


def importance(df: DataFrame) -> Column:
    """Rank score from columns similarity, centrality, is_seed, path_quality, type, path, query_text, token_count, grounded."""
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in schema.ROLE_WEIGHTS.items() for x in kv])[F.col("type")], F.lit(schema.DEFAULT_ROLE_WEIGHT))
    base = 0.85 * schema.ALPHA * F.col("similarity") + 0.85 * schema.BETA * F.col("centrality") + schema.GAMMA * F.col("is_seed").cast("int") + 0.15 * F.col("path_quality")
    x = base * role * T.file_type_multiplier(F.col("path")) + T.query_path_boost(F.col("query_text"), F.col("path"))
    x = x * (1 - 0.1 * F.least(F.col("token_count"), F.lit(1000)) / 1000)
    x = F.when(F.col("grounded"), x * 1.2).when(~F.col("grounded"), x * 0.5).otherwise(x)
    return F.least(x, F.lit(1.0))


def token_overlap(queries: DataFrame, tags: DataFrame, k: int) -> DataFrame:
    """(query_id, tag, score, rank): share of a query's code tokens that a tag has, best k.  Queries of equal tokens are looked up once."""
    q = queries.select("query_id", F.array_sort(F.array_distinct(T.code_tokens(F.col("text")))).alias("qt"))
    asked = q.select(F.col("qt").alias("query_id")).distinct()
    exploded = asked.select("query_id", F.explode("query_id").alias("t")).join(tags.select("tag", F.explode(T.code_tokens(F.col("tag"))).alias("t")), "t")
    scores = exploded.groupBy("query_id", "tag").agg(F.count(F.lit(1)).alias("c")).select("query_id", "tag", (F.col("c") / F.size("query_id")).alias("score"))
    best = top_k(scores, k, "tag").select(F.col("query_id").alias("qt"), "tag", "score")
    return top_k(q.join(best, "qt").select("query_id", "tag", "score"), k, "tag")


def batch(queries: DataFrame, posts: DataFrame, stats: DataFrame, k: int) -> DataFrame:
    """(query_id, status, found): for each query (query_id, text) its best documents in order, or why there are none."""
    asked = queries.filter(F.trim("text") != "")
    best = top_k(bm25(query_terms(asked, "query_id"), posts, stats), k)
    lists = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("l"))
    status = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "error: empty query").otherwise("ok")
    found = F.array_join(F.transform("l", lambda x: x["doc_id"].cast("string")), " ")
    return queries.join(lists, "query_id", "left").select("query_id", status.alias("status"), F.coalesce(found, F.lit("")).alias("found"))
