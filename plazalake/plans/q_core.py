"""Phase 1: the relational core."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.operators import relational as R
from plazalake.plans.roles import NOW, pool, posts, replies, run_log, sql, subreplies
from plazalake.sources.tables import statement_kind, table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("recent_unfeatured", sql("posts", f"SELECT post_id, partition, heat FROM posts WHERE post_time >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND coalesce(featured, 0) <> 1"))
def _(spark, sf):
    return R.recent_unfeatured(posts(spark, sf), NOW, 30).select("post_id", "partition", "heat")


@query("signal_topn", sql("posts", "SELECT post_id, heat + 2 * likes + 3 * comments + 0.1 * views AS signal FROM posts WHERE coalesce(featured, 0) <> 1 ORDER BY signal DESC, post_id LIMIT 600"))
def _(spark, sf):
    return R.signal_topn(posts(spark, sf), 600).select("post_id", "signal")


@query("normalize_rows", sql("posts", "SELECT post_id, coalesce(title, '') AS title, coalesce(featured, 0) AS featured, greatest(likes - 5, 0) AS likes FROM posts"))
def _(spark, sf):
    p = posts(spark, sf).withColumn("raw", (F.col("likes") - 5).cast("string"))
    return p.select("post_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("featured", F.lit(0)).alias("featured"), R.non_negative("raw").alias("likes"))


@query("own_posts_since", sql("posts", "SELECT post_id, title, post_time FROM posts WHERE user_id = 7 AND NOT is_private AND post_time >= TIMESTAMP '2024-01-01 06:00:00'"))
def _(spark, sf):
    return R.visible(posts(spark, sf)).where("user_id = 7 and post_time >= timestamp_ntz '2024-01-01 06:00:00'").select("post_id", "title", "post_time")


@query("locate_post", sql("posts", "SELECT user_id, title, max(post_id) AS post_id FROM posts WHERE post_time >= TIMESTAMP '2024-01-01' GROUP BY ALL"))
def _(spark, sf):
    return posts(spark, sf).where("post_time >= timestamp_ntz '2024-01-01'").groupBy("user_id", "title").agg(F.max("post_id").alias("post_id"))


@query("recent_titles", sql("posts", "SELECT post_id, title FROM posts WHERE trim(title) <> '' AND post_time < TIMESTAMP '2024-01-20' ORDER BY post_time DESC, post_id DESC LIMIT 50"))
def _(spark, sf):
    return posts(spark, sf).where("trim(title) <> '' and post_time < timestamp_ntz '2024-01-20'").orderBy(F.desc("post_time"), F.desc("post_id")).limit(50).select("post_id", "title")


@query("reserved_since", sql("pool", "SELECT id, url, coalesce(points, 0) AS score FROM pool WHERE status = 'reserved' AND last_seen >= TIMESTAMP '2024-01-02' ORDER BY score DESC, id LIMIT 100"))
def _(spark, sf):
    p = pool(spark, sf).where("status = 'reserved' and last_seen >= timestamp_ntz '2024-01-02'")
    return p.select("id", "url", F.coalesce("points", F.lit(0)).cast("long").alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query("publish_day", "SELECT o_orderkey, coalesce((isodow(o_orderdate) - 1) BETWEEN 0 AND 4, true) AS daily, coalesce(isodow(o_orderdate) - 1 = 5, true) AS star FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date").cast("string"))
    return o.select("o_orderkey", R.publish_allowed("day", (0, 4)).alias("daily"), R.publish_allowed("day", (5, 5)).alias("star"))


@query("valid_post_id", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id % 10 END AS post_id FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("raw", (F.col("user_id") % 10).cast("string"))
    return e.select("event_id", F.expr("nullif(try_cast(raw as bigint), 0)").alias("post_id"))


@query("latest_post_id", sql("posts", """SELECT user_id, max_by(post_id, post_time) FILTER (post_time < TIMESTAMP '2024-01-05') AS post_id
    FROM (SELECT user_id, post_time, max(post_id) AS post_id FROM posts GROUP BY ALL) GROUP BY user_id"""))
def _(spark, sf):
    p = posts(spark, sf).groupBy("user_id").agg(F.max(F.when(F.col("post_time") < F.expr("timestamp_ntz '2024-01-05'"), F.struct("post_time", "post_id"))).alias("m"))
    return p.select("user_id", "m.post_id")


@query("saved_answer_lookup", sql("posts replies", """WITH a AS (SELECT post_id, body FROM replies WHERE reply_id % 1000 = 1),
        r AS (SELECT post_id, list(struct_pack(title := 'r' || reply_id, url := 'https://e.com/' || reply_id) ORDER BY reply_id) AS refs FROM replies WHERE post_id % 5 > 0 GROUP BY 1)
    SELECT p.post_id, nullif(trim(a.body), '') AS answer, CASE WHEN p.post_id % 10 = 3 THEN 0 ELSE coalesce(len(refs), 0) END AS used,
        CASE WHEN p.post_id % 10 = 3 OR refs IS NULL THEN '' ELSE array_to_string(list_transform(refs[1:5], lambda x, i: '  [' || i || '] ' || x.title || ' → ' || x.url), chr(10)) END AS listed
    FROM posts p LEFT JOIN a USING (post_id) LEFT JOIN r USING (post_id)"""))
def _(spark, sf):
    """Answers with their references in JSON: broken in some rows, absent in others."""
    r = replies(spark, sf)
    ref = F.struct(F.concat(F.lit("r"), "reply_id").alias("title"), F.concat(F.lit("https://e.com/"), "reply_id").alias("url"))
    refs = r.where("post_id % 5 > 0").groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("reply_id", ref.alias("ref")))).alias("all"))
    text = F.when(F.col("post_id") % 10 == 3, '[{"title": ').otherwise(F.to_json(F.transform("all", lambda x: x["ref"])))
    a = r.where("reply_id % 1000 = 1").select("post_id", F.col("body").alias("answer"))
    saved = posts(spark, sf).select("post_id").join(a, "post_id", "left").join(refs.select("post_id", text.alias("references_json")), "post_id", "left")
    return R.saved_answers(saved).select("post_id", "answer", "used", "listed")


@query("statement_guard", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 3 THEN 'read' WHEN 4 THEN 'write' ELSE 'rejected' END AS kind FROM orders""")
def _(spark, sf):
    text = F.expr("""case o_orderkey % 6 when 0 then concat('select ', o_orderkey) when 1 then concat('INSERT INTO Assist_Responses VALUES (', o_orderkey, ')')
        when 2 then concat('delete from posts where id = ', o_orderkey) when 3 then concat(' \n\tSELECT * from t where k = ', o_orderkey) when 4 then 'update assist_responses set a = 1' end""")
    return table(spark, sf, "orders").select("o_orderkey", statement_kind(text).alias("kind"))


@query("typed_stats", "SELECT event_id, user_id FROM events WHERE user_id % 9 <> 0")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string"), F.expr("case when user_id % 9 = 0 then 'x' else cast(user_id as string) end").alias("user_id"))
    return R.typed_stats(e, ["event_id", "user_id"])


@query("reply_hits", sql("posts replies", """SELECT r.post_id, count(*) AS hits FROM replies r JOIN posts p USING (post_id)
    WHERE NOT p.is_private AND contains(lower(r.body), 'th') GROUP BY 1 ORDER BY hits DESC, post_id LIMIT 30"""))
def _(spark, sf):
    return R.hits_per_post(posts(spark, sf), replies(spark, sf), "th", 30)


@query("subreply_hits", sql("posts replies subreplies", """SELECT r.post_id, count(*) AS hits FROM subreplies s JOIN replies r USING (reply_id) JOIN posts p USING (post_id)
    WHERE NOT p.is_private AND contains(lower(s.body), 'en') GROUP BY 1 ORDER BY hits DESC, post_id LIMIT 30"""))
def _(spark, sf):
    return R.subreply_hits(posts(spark, sf), replies(spark, sf), subreplies(spark, sf), "en", 30)


_ANSWERS = "answers AS (SELECT doc_id AS post_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'a' END AS answer FROM labels)"


def _answers(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("post_id"), F.expr("case when doc_id % 3 = 0 then ' ' else 'a' end").alias("answer"))


@query("pending_anti_join", sql("posts", f"WITH {_ANSWERS} SELECT p.post_id, p.title FROM posts p LEFT JOIN answers a ON a.post_id = p.post_id AND trim(coalesce(a.answer, '')) <> '' WHERE a.post_id IS NULL AND p.title <> ''"))
def _(spark, sf):
    return R.pending(posts(spark, sf), _answers(spark, sf)).where("title <> ''").select("post_id", "title")


@query("pending_count", sql("posts", f"WITH {_ANSWERS} SELECT count(*) AS pending FROM posts p WHERE NOT EXISTS (SELECT 1 FROM answers a WHERE a.post_id = p.post_id AND trim(a.answer) <> '')"))
def _(spark, sf):
    return R.pending(posts(spark, sf), _answers(spark, sf)).agg(F.count(F.lit(1)).alias("pending"))


@query("meta_semi_join", sql("posts", "SELECT post_id, title, heat FROM posts WHERE post_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def _(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("post_id"))
    return posts(spark, sf).join(ids, "post_id", "left_semi").select("post_id", "title", "heat")


@query("cooling_anti_join", sql("posts", f"SELECT post_id FROM posts WHERE post_id NOT IN (SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 710 HOUR)"))
def _(spark, sf):
    cooling = table(spark, sf, "events").where(f"ts >= timestamp_ntz '{NOW}' - interval 710 hours").select(F.col("event_id").alias("post_id"))
    return posts(spark, sf).join(cooling, "post_id", "left_anti").select("post_id")


@query("topk_replies", """SELECT l_orderkey, l_linenumber, l_quantity, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= 2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    found = R.top_per_parent(li, "l_orderkey", 2, F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_extendedprice"))
    return found.select("l_orderkey", "l_linenumber", "l_quantity", F.col("rank").cast("long").alias("rank"))


@query("topk_keyword_hits", sql("replies", """WITH k(keyword) AS (VALUES ('the'), ('und'), ('que'), ('la'))
    SELECT keyword, reply_id, likes, rank FROM (SELECT keyword, reply_id, likes, row_number() OVER (PARTITION BY keyword ORDER BY likes DESC, reply_id DESC) AS rank
    FROM replies, k WHERE contains(lower(body), keyword)) WHERE rank <= 3"""))
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in ("the", "und", "que", "la")])
    hits = replies(spark, sf).withColumn("keyword", F.explode(F.filter(words, lambda w: F.contains(F.lower("body"), w))))
    return R.top_per_parent(hits, "keyword", 3, F.desc("likes"), F.desc("reply_id")).select("keyword", "reply_id", "likes", F.col("rank").cast("long").alias("rank"))


@query("counts_by_kind_status", sql("pool", "SELECT kind, status, count(*) AS n FROM pool GROUP BY ALL"))
def _(spark, sf):
    return pool(spark, sf).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_totals", "SELECT count(*) AS n, coalesce(sum(CASE WHEN event_type = 'click' THEN 1 END), 0) AS up, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 END), 0) AS down FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def _(spark, sf):
    e = table(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-10'")
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("up"), F.count_if(F.col("event_type") == "error").alias("down"))


@query("high_water_mark", sql("posts replies", "SELECT 'posts' AS kind, max(post_time) AS mark FROM posts UNION ALL SELECT 'replies', max(time) FROM replies"))
def _(spark, sf):
    a = posts(spark, sf).agg(F.max("post_time").alias("mark")).select(F.lit("posts").alias("kind"), "mark")
    return a.union(replies(spark, sf).agg(F.max("time").alias("mark")).select(F.lit("replies").alias("kind"), "mark"))


@query("point_count", "SELECT count(*) AS points FROM embeddings")
def _(spark, sf):
    return table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("points"))


@query("run_caps", sql("posts", f"SELECT post_id FROM (SELECT post_id, post_time FROM posts WHERE coalesce(featured, 0) <> 1 ORDER BY post_time DESC, post_id DESC LIMIT 600) ORDER BY post_time DESC, post_id DESC LIMIT 80"))
def _(spark, sf):
    order = (F.desc("post_time"), F.desc("post_id"))
    return R.recent_unfeatured(posts(spark, sf), NOW, 60).orderBy(*order).limit(600).orderBy(*order).limit(80).select("post_id")


@query("existence_checks", sql("run_log", "SELECT p.doc_id, EXISTS (SELECT 1 FROM run_log r WHERE r.id = p.doc_id AND r.tag = 'published') AS published FROM documents p"))
def _(spark, sf):
    done = run_log(spark, sf).where("tag = 'published'").select(F.col("id").alias("doc_id")).distinct().withColumn("published", F.lit(True))
    return table(spark, sf, "documents").join(done, "doc_id", "left").select("doc_id", F.coalesce("published", F.lit(False)).alias("published"))


@query("first_by_id", "SELECT c_nationkey, min(c_custkey) AS user_id, max(c_custkey) AS newest FROM customer GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("user_id"), F.max("c_custkey").alias("newest"))
