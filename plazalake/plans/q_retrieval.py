"""Phase 2: hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazalake.operators import relational as R
from plazalake.operators import retrieval as V
from plazalake.plans.roles import pool, posts, replies, sql, subreplies
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}
WORDS = ["the", "und", "eau", "ción"]
_VALUES = ", ".join(f"('{w}')" for w in WORDS)
#: One question of three vectors, the points of the lowest ids: what is best per post, and fusion.
N_QUERIES, K, THRESHOLD = 3, 12, 0.2
#: A search: every point whose id is divisible by this is a query.
EVERY = 20


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


_KEYWORD = f"""k(w) AS (VALUES {_VALUES}),
    own AS (SELECT post_id, CAST(2 * contains(lower(title), w)::INT + contains(lower(body), w)::INT AS DOUBLE) AS s FROM posts, k WHERE NOT is_private),
    r1 AS (SELECT r.post_id, w, count(*) AS n FROM replies r JOIN posts p ON p.post_id = r.post_id AND NOT p.is_private, k WHERE contains(lower(r.body), w) GROUP BY ALL),
    r2 AS (SELECT r.post_id, w, count(*) AS n FROM subreplies s JOIN replies r USING (reply_id) JOIN posts p ON p.post_id = r.post_id AND NOT p.is_private, k WHERE contains(lower(s.body), w) GROUP BY ALL),
    kw AS (SELECT post_id, least(6.0::DOUBLE, sum(s)) AS keyword FROM (SELECT post_id, s FROM own UNION ALL SELECT post_id, least(2.0::DOUBLE, n * 0.5::DOUBLE) FROM r1
        UNION ALL SELECT post_id, least(1.5::DOUBLE, n * 0.5::DOUBLE) FROM r2) GROUP BY 1 HAVING sum(s) > 0)"""


def _vector_sql(queries: str) -> str:
    return f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
    q AS (SELECT vec_id AS query_id, e AS qe, n AS qn FROM v {queries}),
    sc AS (SELECT query_id, vec_id, label, list_inner_product(e, qe) / (n * qn) AS score FROM v, q),
    vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc WHERE score >= {THRESHOLD}) WHERE rank <= {K}),
    vb AS (SELECT vec_id AS post_id, max(score) AS vector, count(*) AS hits FROM vt GROUP BY 1)"""


_VECTOR, _SEARCH = _vector_sql(f"ORDER BY vec_id LIMIT {N_QUERIES}"), _vector_sql(f"WHERE vec_id % {EVERY} = 0")


def _keyword(spark, sf):
    return V.keyword_score(posts(spark, sf), replies(spark, sf), subreplies(spark, sf), WORDS)


def _nearest(points, queries):
    return V.nearest(points, queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), K, THRESHOLD)


def _vector(spark, sf):
    e = table(spark, sf, "embeddings")
    return _nearest(e, e.orderBy("vec_id").limit(N_QUERIES))


def _asked(points):
    return points.where(F.col("vec_id") % EVERY == 0)


def _search(spark, sf):
    e = table(spark, sf, "embeddings")
    return _nearest(e, _asked(e))


@query("keyword_score", sql("posts replies subreplies", f"WITH {_KEYWORD} SELECT post_id, keyword FROM kw"))
def _(spark, sf):
    return _keyword(spark, sf)


@query("vector_topk", f"WITH {_SEARCH} SELECT query_id, vec_id, label, round(score, 9) AS score, rank FROM vt")
def _(spark, sf):
    return _search(spark, sf).select("query_id", "vec_id", "label", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_best_per_post", f"WITH {_VECTOR} SELECT post_id, round(vector, 9) AS vector, hits FROM vb")
def _(spark, sf):
    """One question in three wordings, the vectors of the lowest ids, against all points."""
    return V.best_per_post(_vector(spark, sf).withColumnRenamed("vec_id", "post_id")).select("post_id", F.round("vector", 9).alias("vector"), "hits")


@query("fusion_rank", sql("posts replies subreplies", f"""WITH {_KEYWORD}, {_VECTOR},
    c AS (SELECT coalesce(kw.post_id, vb.post_id) AS post_id, keyword, vector FROM kw FULL JOIN vb ON kw.post_id = vb.post_id),
    m AS (SELECT c.*, p.title, p.heat FROM c LEFT JOIN (SELECT * FROM posts WHERE NOT is_private) p USING (post_id)),
    b AS (SELECT max(keyword) AS top, min(heat) AS low, max(heat) AS high FROM m),
    s AS (SELECT post_id, coalesce(title, '') AS title, coalesce(heat, 0) AS heat, 0.48 * coalesce(vector, 0) + 0.27 * coalesce(keyword, 0) / top
        + 0.08 * CASE WHEN high > low THEN (coalesce(heat, 0) - low) / (high - low) ELSE 0 END AS score FROM m, b)
    SELECT post_id, title, heat, round(score, 9) AS score FROM s ORDER BY s.score DESC, post_id LIMIT 50"""))
def _(spark, sf):
    """One question in three wordings, the vectors of the lowest ids, against all points and all posts."""
    vector = V.best_per_post(_vector(spark, sf).withColumnRenamed("vec_id", "post_id"))
    found = V.fuse(_keyword(spark, sf), vector, R.visible(posts(spark, sf)), 50)
    return found.withColumn("score", F.round("score", 9))


_EVIDENCE = """h AS (SELECT reply_id AS comment_id, post_id, likes, 0.6::DOUBLE AS score, 'keyword' AS source, 0 AS ord FROM replies WHERE contains(lower(body), 'the')
    UNION ALL SELECT reply_id, post_id, 0, CAST(length(body) % 100 AS DOUBLE) / 100, 'vector', 1 FROM replies WHERE contains(lower(body), 'and')),
    ev AS (SELECT comment_id, min_by(post_id, ord) AS post_id, max(score) AS score, coalesce(min_by(likes, ord) FILTER (likes <> 0), 0) AS likes,
        string_agg(source, '+' ORDER BY ord) AS source FROM h GROUP BY 1 ORDER BY score DESC, comment_id LIMIT 200)"""


def _evidence(spark, sf):
    r = replies(spark, sf)
    a = r.where(F.contains(F.lower("body"), F.lit("the"))).select(F.col("reply_id").alias("comment_id"), "post_id", "likes", F.lit(0.6).alias("score"), F.lit("keyword").alias("source"), F.lit(0).alias("ord"))
    b = r.where(F.contains(F.lower("body"), F.lit("and"))).select("reply_id", "post_id", F.lit(0).cast("long"), (F.char_length("body") % 100).cast("double") / 100, F.lit("vector"), F.lit(1))
    return V.merge_evidence(a.union(b), 200)


@query("comment_evidence", sql("replies", f"WITH {_EVIDENCE} SELECT comment_id, post_id, score, CAST(likes AS BIGINT) AS likes, source FROM ev"))
def _(spark, sf):
    return _evidence(spark, sf)


@query("orphan_promotion", sql("replies", f"""WITH {_EVIDENCE}, rest AS (SELECT * FROM ev WHERE post_id % 3 <> 0),
    best AS (SELECT post_id, max(score) AS best FROM rest GROUP BY 1 ORDER BY best DESC, post_id LIMIT 3)
    SELECT post_id, comment_id, score, place FROM (SELECT rest.*, row_number() OVER (PARTITION BY post_id ORDER BY score DESC, comment_id) AS place FROM rest JOIN best USING (post_id)) WHERE place <= 2"""))
def _(spark, sf):
    cands = posts(spark, sf).where("post_id % 3 = 0")
    return V.promote_orphans(_evidence(spark, sf), cands, 3, 2).select("post_id", "comment_id", "score", F.col("place").cast("long").alias("place"))


@query("context_topk", sql("posts replies subreplies", """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY likes DESC, reply_id DESC) AS place FROM replies) WHERE place <= 2),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY likes DESC, sub_id) AS place FROM subreplies) WHERE place <= 3)
    SELECT r.post_id, r.reply_id, r.place, s.sub_id, left(r.body, 300) AS reply, left(s.body, 200) AS sub FROM r JOIN posts p ON p.post_id = r.post_id AND NOT p.is_private LEFT JOIN s ON s.reply_id = r.reply_id"""))
def _(spark, sf):
    r = R.top_per_parent(replies(spark, sf), "post_id", 2, F.desc("likes"), F.desc("reply_id")).withColumnRenamed("rank", "place")
    s = R.top_per_parent(subreplies(spark, sf), "reply_id", 3, F.desc("likes"), F.col("sub_id")).select("reply_id", "sub_id", F.substring("body", 1, 200).alias("sub"))
    found = r.join(R.visible(posts(spark, sf)).select("post_id"), "post_id", "left_semi").join(s, "reply_id", "left")
    return found.select("post_id", "reply_id", F.col("place").cast("long").alias("place"), "sub_id", F.substring("body", 1, 300).alias("reply"), "sub")


@query("rag_relaxed_filter", sql("posts", """WITH t AS (SELECT post_id, partition, partition = 'xx' AS strict FROM posts WHERE NOT is_private)
    SELECT post_id, partition FROM t WHERE strict OR NOT (SELECT bool_or(strict) FROM t)"""))
def _(spark, sf):
    return V.strict_or_relaxed(R.visible(posts(spark, sf)), F.col("partition") == "xx").select("post_id", "partition")


@query("rag_rank_score", sql("replies", """SELECT post_id, reply_id, round(1.0::DOUBLE / rank, 4) AS score FROM
    (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY likes DESC, reply_id) AS rank FROM replies) WHERE rank <= 5"""))
def _(spark, sf):
    r = R.top_per_parent(replies(spark, sf), "post_id", 5, F.desc("likes"), F.col("reply_id"))
    return r.select("post_id", "reply_id", F.round(1 / F.col("rank"), 4).alias("score"))


@query("weak_retrieval_flag", f"WITH {_SEARCH} SELECT q.query_id, coalesce(max(vt.score), 0) < 0.5 OR count(vt.vec_id) = 0 AS weak FROM q LEFT JOIN vt ON vt.query_id = q.query_id AND vt.vec_id <> q.query_id GROUP BY 1")
def _(spark, sf):
    hits = _search(spark, sf).where("vec_id <> query_id").groupBy("query_id").agg(F.max("score").alias("top"))
    asked = _asked(table(spark, sf, "embeddings")).select(F.col("vec_id").alias("query_id"))
    return asked.join(hits, "query_id", "left").select("query_id", (F.coalesce("top", F.lit(0.0)) < 0.5).alias("weak"))


@query("pool_or_live", sql("pool", f"""WITH p AS (SELECT id, source, kind FROM pool WHERE status = 'reserved' AND first_seen >= TIMESTAMP '2024-01-20'), l AS (SELECT id, source, kind FROM pool WHERE kind = 'news' OR id % 3 = 0)
    SELECT * FROM p UNION ALL SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.source = l.source)"""))
def _(spark, sf):
    """What is reserved since a day; for sources without any, what was fetched."""
    p = pool(spark, sf)
    kept = p.where("status = 'reserved' and first_seen >= timestamp_ntz '2024-01-20 00:00:00'").select("id", "source", "kind")
    return R.use_fallback(kept, p.where("kind = 'news' or id % 3 = 0").select("id", "source", "kind"), ["source"])


@query("keyword_posts", sql("posts", f"""WITH k(word) AS (VALUES {_VALUES}),
    s AS (SELECT word, post_id, heat, 2 * coalesce(contains(lower(title), word), false)::BIGINT + coalesce(contains(lower(body), word), false)::BIGINT AS score FROM posts, k WHERE NOT is_private)
    SELECT word, post_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, heat DESC, post_id) AS rank FROM s WHERE score > 0) WHERE rank <= 30"""))
def _(spark, sf):
    found = V.keyword_posts(posts(spark, sf), WORDS)
    return found.select("word", "post_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
