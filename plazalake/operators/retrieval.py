"""Hybrid retrieval: keyword scores, nearest vectors and popularity in one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazalake.operators.knn import nearest_by_pivots
from plazalake.operators.relational import visible
from plazalake.sources.shared import cut

VECTOR_WEIGHT, KEYWORD_WEIGHT, HEAT_WEIGHT = 0.48, 0.27, 0.08
KEYWORD_CAP, REPLY_CAP, SUBREPLY_CAP = 6.0, 2.0, 1.5


def _keywords(body: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(body, w))


def keyword_score(posts: DataFrame, replies: DataFrame, subs: DataFrame, words: list[str]) -> DataFrame:
    """post_id, keyword score: of each word 2 in the title, 1 in the body, and half a point per reply and sub-reply within caps.

    The text side is scanned once for all words; counts are summed before they meet posts.
    """
    public = visible(posts).select("post_id", "title", "body")
    title, body = F.lower("title"), F.lower("body")
    own = public.select("post_id", (2 * F.size(_keywords(title, words)) + F.size(_keywords(body, words))).cast("double").alias("s"))

    def by_word(rows, cap):
        hits = rows.select("post_id", F.explode(_keywords(F.lower("body"), words)).alias("word")).groupBy("post_id", "word").agg(F.count(F.lit(1)).alias("n"))
        return hits.select("post_id", F.least(F.lit(cap), F.col("n") * 0.5).alias("s"))

    below = by_word(replies.select("post_id", "body"), REPLY_CAP).union(by_word(subs.join(replies.select("reply_id", "post_id"), "reply_id").select("post_id", "body"), SUBREPLY_CAP))
    below = below.join(public.select("post_id"), "post_id", "left_semi")
    return own.union(below).groupBy("post_id").agg(F.least(F.lit(KEYWORD_CAP), F.sum("s")).alias("keyword")).where("keyword > 0")


def keyword_posts(posts: DataFrame, words: list[str], n: int = 30) -> DataFrame:
    """word, post_id, score, heat, rank: of each word the n visible posts that hold it, 2 for the title and 1 for the body, then by heat, then by id."""
    title, body = F.lower("title"), F.lower("body")
    score = F.when(F.contains(title, F.col("word")), 2).otherwise(0) + F.when(F.contains(body, F.col("word")), 1).otherwise(0)
    either = F.array_distinct(F.concat(_keywords(F.coalesce(title, F.lit("")), words), _keywords(F.coalesce(body, F.lit("")), words)))
    hits = visible(posts).select("post_id", F.coalesce("heat", F.lit(0.0)).alias("heat"), "title", "body", F.explode(either).alias("word")).withColumn("score", score)
    best = Window.partitionBy("word").orderBy(F.desc("score"), F.desc("heat"), "post_id")
    return hits.select("word", "post_id", "score", "heat").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def nearest(points: DataFrame, queries: DataFrame, k: int, threshold: float) -> DataFrame:
    """query_id, vec_id, label, score, rank: of each query (query_id, q) the k points (vec_id, label, embedding) of the highest cosine, at least threshold, then of the lowest id."""
    return nearest_by_pivots(points, queries, k, threshold)[0]


def best_per_post(hits: DataFrame) -> DataFrame:
    return hits.groupBy("post_id").agg(F.max("score").alias("vector"), F.count(F.lit(1)).alias("hits"))


def fuse(keyword: DataFrame, vector: DataFrame, meta: DataFrame, n: int) -> DataFrame:
    """The n best of all candidates. Heat is scaled between the least and the most of candidates with metadata; of the others it is 0."""
    found = keyword.join(vector.select("post_id", "vector"), "post_id", "full_outer").join(meta.select("post_id", "title", "heat"), "post_id", "left")
    found = cut(found, "candidates")
    span = found.agg(F.max("keyword").alias("top"), F.min("heat").alias("low"), F.max("heat").alias("high"))
    rows = found.join(F.broadcast(span), F.lit(True))
    kw = F.when(F.col("top") > 0, F.coalesce(F.col("keyword"), F.lit(0.0)) / F.col("top")).otherwise(0.0)
    heat = F.when(F.col("high") > F.col("low"), (F.coalesce("heat", F.lit(0.0)) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    score = VECTOR_WEIGHT * F.coalesce("vector", F.lit(0.0)) + KEYWORD_WEIGHT * kw + HEAT_WEIGHT * heat
    return rows.select("post_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("heat", F.lit(0.0)).alias("heat"), score.alias("score")).orderBy(F.desc("score"), "post_id").limit(n)


def merge_evidence(hits: DataFrame, n: int) -> DataFrame:
    """Hits on the same comment, in order of arrival (ord), become one: best score, first non-zero likes, sources joined."""
    first = F.when(F.col("likes") != 0, F.struct("ord", "likes"))
    merged = hits.groupBy("comment_id").agg(
        F.min_by("post_id", "ord").alias("post_id"),
        F.max("score").alias("score"),
        F.coalesce(F.min(first)["likes"], F.lit(0)).alias("likes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source"))), lambda x: x["source"]), "+").alias("source"),
    )
    return merged.orderBy(F.desc("score"), "comment_id").limit(n)


def promote_orphans(evidence: DataFrame, candidates: DataFrame, n: int, each: int) -> DataFrame:
    """Parents that aren't candidates: the n of the best evidence, `each` comments of each."""
    rest = evidence.join(candidates.select("post_id"), "post_id", "left_anti")
    best = rest.groupBy("post_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "post_id").limit(n)
    order = Window.partitionBy("post_id").orderBy(F.desc("score"), "comment_id")
    return rest.join(F.broadcast(best), "post_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)


def strict_or_relaxed(rows: DataFrame, strict: Column) -> DataFrame:
    """Rows that meet the condition; all rows if none does."""
    marked = rows.withColumn("_strict", F.coalesce(strict, F.lit(False)))
    some = marked.agg(F.coalesce(F.bool_or("_strict"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some), F.lit(True)).where("_strict or not _some").drop("_strict", "_some")
