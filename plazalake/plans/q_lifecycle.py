"""Phase 4: life-cycle of keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.operators import lifecycle as L
from plazalake.plans.roles import pool, posts, run_log, sql
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}
NOW = "2024-01-08 00:00:00"


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"), F.col("o_totalprice").alias("price"))


@query("upsert_latest_wins", "SELECT o_custkey AS k, max(o_orderkey) AS ver, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def _(spark, sf):
    o = _orders(spark, sf)
    return L.latest_wins(o.where("ver % 3 = 0"), o.where("ver % 3 <> 0"), ["k"], "ver")


@query("issue_numbering", """WITH n AS (SELECT c_custkey AS day, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS title FROM customer),
    o AS (SELECT c_custkey AS day, c_custkey * 2 AS issue_no, 'old ' || c_custkey AS title FROM customer WHERE c_custkey % 2 = 0),
    f AS (SELECT day, 10000000 + row_number() OVER (ORDER BY day) - 1 AS dealt FROM n WHERE day NOT IN (SELECT day FROM o))
    SELECT n.day, CAST(coalesce(o.issue_no, f.dealt) AS BIGINT) AS issue_no, coalesce(nullif(n.title, ''), o.title) AS title FROM n LEFT JOIN o USING (day) LEFT JOIN f USING (day)""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "day")
    old = c.where("day % 2 = 0").select("day", (F.col("day") * 2).alias("issue_no"), F.concat(F.lit("old "), "day").alias("title"))
    return L.issue_numbers(old, c.select("day", F.expr("case when day % 4 = 0 then '' else c_name end").alias("title")), "day", 10_000_000, F.floor(F.col("day") / 100))


@query("point_update", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    changes = c.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select("c_custkey", F.expr("case when c_custkey % 5 = 0 then null else 'new' end").alias("segment"))
    return L.point_update(c, changes, "c_custkey", "segment")


@query("idempotency_marker", "SELECT 'daily_posted:' || CAST(o_orderdate AS DATE) AS key, max(o_orderkey) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    kv = table(spark, sf, "orders").select(F.concat(F.lit("daily_posted:"), F.to_date("o_orderdate")).alias("key"), F.col("o_orderkey").alias("value"))
    return L.latest_wins(kv.where("value % 2 = 0"), kv.where("value % 2 = 1"), ["key"], "value")


@query("conditional_upsert", """SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NOT NULL AND coalesce(n.answer, '') = '' THEN o.answer ELSE n.answer END AS answer,
    CASE WHEN o.k IS NOT NULL AND coalesce(n.answer, '') = '' THEN o.n ELSE n.n END AS n
    FROM (SELECT c_custkey AS k, c_name AS answer, 1 AS n FROM customer WHERE c_custkey % 2 = 0) o
    FULL JOIN (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS answer, 2 AS n FROM customer WHERE c_custkey % 5 <> 0) n ON o.k = n.k""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "k")
    old = c.where("k % 2 = 0").select("k", F.col("c_name").alias("answer"), F.lit(1).alias("n"))
    new = c.where("k % 5 <> 0").select("k", F.expr("case k % 3 when 0 then null when 1 then '' else c_mktsegment end").alias("answer"), F.lit(2).alias("n"))
    return L.conditional_upsert(old, new, "k", "answer")


@query("counter_increment", "SELECT c_custkey, c_custkey % 10 + coalesce(n, 0) AS helpful FROM customer LEFT JOIN (SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events GROUP BY 1) ON user_id = c_custkey")
def _(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 10).alias("helpful"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("c_custkey"), (F.col("event_type") == "click").cast("int").alias("delta"))
    return L.increment(old, e, "c_custkey", "helpful")


def _items(spark, sf):
    return pool(spark, sf).where("id % 3 = 0").select("kind", F.expr("case when id % 2 = 0 then url else concat(url, '?p=2') end").alias("url"), "title", (F.col("id") * 2).alias("points"), F.col("id").alias("ord"))


@query("pool_upsert_exact", sql("pool", f"SELECT id, url, CASE WHEN id % 6 = 0 THEN TIMESTAMP '{NOW}' ELSE last_seen END AS last_seen, CASE WHEN id % 6 = 0 THEN id * 2 ELSE points END AS points FROM pool"))
def _(spark, sf):
    return L.pool_upsert_exact(pool(spark, sf), _items(spark, sf), NOW)[0].select("id", "url", "last_seen", "points")


@query("pool_insert_exact", sql("pool", "SELECT kind, url || '?p=2' AS url, title, id * 2 AS points FROM pool WHERE id % 3 = 0 AND id % 2 = 1"))
def _(spark, sf):
    return L.pool_upsert_exact(pool(spark, sf), _items(spark, sf), NOW)[1].select("kind", "url", "title", "points")


@query("trending_upsert", sql("pool", f"SELECT url, CASE WHEN id % 6 = 3 THEN id * 2 ELSE points END AS points FROM pool WHERE kind = 'trending'"))
def _(spark, sf):
    trending = pool(spark, sf).where("kind = 'trending'")
    items = trending.where("id % 6 = 3").select("kind", "url", "title", (F.col("id") * 2).alias("points"), F.col("id").alias("ord"))
    return L.pool_upsert_exact(trending, items, NOW)[0].select("url", "points")


@query("stage_write", sql("pool", "SELECT url, CASE WHEN id % 4 = 0 THEN 'draft ' || id END AS draft FROM pool"))
def _(spark, sf):
    p = pool(spark, sf).withColumn("draft", F.lit(None).cast("string"))
    changes = p.where("id % 4 = 0").select("url", F.concat(F.lit("draft "), "id").alias("draft"))
    return L.stage_write(p, changes, "draft").select("url", "draft")


@query("mark_consumed", sql("pool", "SELECT id, CASE WHEN id % 3 = 0 AND status = 'candidate' AND kind = 'news' THEN 'daily_used' ELSE status END AS status FROM pool"))
def _(spark, sf):
    p = pool(spark, sf)
    return L.transition(p, p.where("id % 3 = 0"), "candidate", "daily_used").select("id", "status")


@query("mark_reserved", sql("pool", "SELECT id, CASE WHEN id % 5 < 2 AND status = 'candidate' AND kind = 'news' THEN 'reserved' ELSE status END AS status FROM pool"))
def _(spark, sf):
    p = pool(spark, sf)
    return L.transition(p, p.where("id % 5 < 2"), "candidate", "reserved").select("id", "status")


_SWEEP = f"""a AS (SELECT *, status AS before, CASE WHEN kind = 'news' AND status = 'candidate' AND last_seen < TIMESTAMP '{NOW}' - INTERVAL 3 DAY THEN 'expired'
    WHEN kind = 'news' AND status = 'reserved' AND last_seen < TIMESTAMP '{NOW}' - INTERVAL 4 DAY THEN 'expired' ELSE status END AS aged FROM pool),
    w AS (SELECT id, kind, before, CASE WHEN (kind = 'news' AND aged = 'expired' AND last_seen < TIMESTAMP '{NOW}' - INTERVAL 5 DAY) OR (kind <> 'news' AND last_seen < TIMESTAMP '{NOW}' - INTERVAL 6 DAY)
        THEN 'deleted' ELSE aged END AS status FROM a)"""


@query("sweep", sql("pool", f"WITH {_SWEEP} SELECT id, before, status FROM w"))
def _(spark, sf):
    return L.sweep(pool(spark, sf), NOW, 3, 4, 5, 6).select("id", "before", "status")


@query("sweep_counts", sql("pool", f"WITH {_SWEEP} SELECT kind, before, status, count(*) AS n FROM w WHERE before <> status GROUP BY ALL"))
def _(spark, sf):
    return L.sweep(pool(spark, sf), NOW, 3, 4, 5, 6).where("before <> status").groupBy("kind", "before", "status").agg(F.count(F.lit(1)).alias("n"))


@query("cooldown_active", "SELECT CAST(user_id AS VARCHAR) AS source, max(ts) + INTERVAL 24 HOUR AS until FROM events WHERE event_type = 'error' GROUP BY 1 HAVING max(ts) + INTERVAL 24 HOUR > TIMESTAMP '2024-01-30 12:00:00'")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("source"), "ts", "event_type")
    return L.active_cooldowns(e, 24, "2024-01-30 12:00:00", F.col("event_type") == "error")


@query("retention_runlog", sql("run_log", """SELECT id, task FROM run_log WHERE tag = 'published' AND ts >= TIMESTAMP '2024-01-10'
    UNION ALL SELECT id, task FROM (SELECT id, task FROM run_log WHERE coalesce(tag, '') <> 'published' ORDER BY id DESC LIMIT 500)"""))
def _(spark, sf):
    return L.retain(run_log(spark, sf), "2024-01-10", 500, F.coalesce(F.col("tag") == "published", F.lit(False))).select("id", "task")


@query("vector_delete_count", "SELECT count(*) AS before, count(*) FILTER (label <> 3) AS after, count(*) FILTER (label = 3) AS deleted FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return L.delete_counted(e, e.where("label = 3"), "vec_id")[1]


def _decisions(spark, sf):
    d = run_log(spark, sf)
    return d.select("id", F.col("user_id").alias("post_id"), "ts", (F.col("value") > 50).alias("featured"), F.expr("case when id % 3 = 0 then true when id % 3 = 1 then false end").alias("marked"))


_DECISIONS = "d AS (SELECT id, user_id AS post_id, ts, value > 50 AS featured, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS marked FROM run_log)"


@query("decision_backfill", sql("run_log", f"WITH {_DECISIONS} SELECT id, CASE WHEN featured AND NOT coalesce(marked, false) AND post_id % 2 = 0 THEN true ELSE marked END AS marked FROM d"))
def _(spark, sf):
    d = _decisions(spark, sf)
    return L.backfill(d, d.where("post_id % 2 = 0")).select("id", "marked")


@query("pending_featured", sql("run_log", f"WITH {_DECISIONS} SELECT DISTINCT post_id FROM d WHERE featured AND NOT coalesce(marked, false)"))
def _(spark, sf):
    return _decisions(spark, sf).where("featured and not coalesce(marked, false)").select("post_id").distinct().orderBy("post_id")


@query("recently_judged", sql("run_log", f"WITH {_DECISIONS} SELECT DISTINCT post_id FROM d WHERE ts >= TIMESTAMP '2024-01-30 04:00:00'"))
def _(spark, sf):
    return _decisions(spark, sf).where("ts >= timestamp_ntz '2024-01-30 04:00:00'").select("post_id").distinct()


@query("run_counters", sql("run_log", f"WITH {_DECISIONS} SELECT CAST(ts AS DATE) AS day, count(*) AS judged, count(*) FILTER (featured) AS featured, count(*) FILTER (marked IS NULL) AS unmarked, count(DISTINCT post_id) AS posts FROM d GROUP BY 1"))
def _(spark, sf):
    d = _decisions(spark, sf).groupBy(F.to_date("ts").alias("day"))
    return d.agg(F.count(F.lit(1)).alias("judged"), F.count_if("featured").alias("featured"), F.count_if(F.col("marked").isNull()).alias("unmarked"), F.count_distinct("post_id").alias("posts"))


@query("skip_existing", "SELECT doc_id FROM documents WHERE md5('post:' || doc_id) NOT IN (SELECT md5('post:' || vec_id) FROM embeddings)")
def _(spark, sf):
    have = table(spark, sf, "embeddings").select(F.md5(F.concat(F.lit("post:"), "vec_id")).alias("h"))
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.lit("post:"), "doc_id")).alias("h"))
    return d.join(have, "h", "left_anti").select("doc_id")


@query("fresh_cache", sql("pool", "SELECT id, kind = 'news' AND status = 'candidate' AND id % 3 = 0 AND md5(title) = md5(CASE WHEN id % 2 = 0 THEN title ELSE url END) AS fresh FROM pool"))
def _(spark, sf):
    p = pool(spark, sf).withColumns({"day": F.col("status"), "version": (F.col("id") % 3).cast("string"), "hash": F.md5("title"), "source_hash": F.md5(F.expr("case when id % 2 = 0 then title else url end"))})
    return p.select("id", L.fresh_cache(p, "news", "candidate", "0").alias("fresh"))


@query("sample_overwrite", "SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return L.latest_wins(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "day"], "event_id")


@query("dedup_single_flight", sql("posts", "SELECT user_id, min(post_id) AS post_id FROM posts GROUP BY 1"))
def _(spark, sf):
    return posts(spark, sf).groupBy("user_id").agg(F.min("post_id").alias("post_id"))
