"""Phase 3: pool and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import pool as P
from plazalake.plans.roles import NOW, pool, posts, sql
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


_HEAT = """s AS (SELECT *, nullif(points, 0) AS signal FROM pool),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, signal IS NOT NULL ORDER BY signal DESC, id) AS place, count(signal) OVER (PARTITION BY source) AS n FROM s),
    heat AS (SELECT *, CASE WHEN signal IS NULL THEN 50.0 WHEN n = 1 THEN 100.0 ELSE round(100.0::DOUBLE * (n - place) / (n - 1), 1) END AS heat FROM r),
    scored AS (SELECT *, heat + 10 * 5 - 5 * (epoch_us(TIMESTAMP '%s') - epoch_us(first_seen)) / 8.64e10 AS score FROM heat)""" % NOW


def _heat(spark, sf):
    return P.rank_heat(pool(spark, sf).withColumn("signal", F.expr("nullif(points, 0)")), "signal")


@query("heat_rank", sql("pool", f"WITH {_HEAT} SELECT id, source, CAST(heat AS DOUBLE) AS heat FROM heat"))
def _(spark, sf):
    return _heat(spark, sf).select("id", "source", "heat")


@query("heat_signal", sql("pool", """SELECT id, src, CASE WHEN src IN ('hacker-news', 'devto', 'juejin') THEN CAST(nullif(points, 0) AS DOUBLE)
    WHEN src = 'zhihu-hot' THEN coalesce(CAST(nullif(points, 0) AS DOUBLE), -CAST(nullif(rank, 0) AS DOUBLE))
    WHEN src = 'github-trending' THEN CAST(nullif(points, 0) AS DOUBLE) END AS signal, CAST(CASE src WHEN 'infoq' THEN 6 WHEN 'github-trending' THEN 5 WHEN 'juejin' THEN 7 ELSE 8 END AS INTEGER) AS weight
    FROM (SELECT *, (['hacker-news', 'devto', 'juejin', 'zhihu-hot', 'github-trending', 'infoq'])[CAST(id % 6 + 1 AS INTEGER)] AS src FROM pool)"""))
def _(spark, sf):
    src = F.expr("element_at(array('hacker-news', 'devto', 'juejin', 'zhihu-hot', 'github-trending', 'infoq'), cast(id % 6 + 1 as int))")
    rows = pool(spark, sf).withColumns({"src": src, "heat": F.col("points"), "today_stars": F.col("points")})
    return rows.select("id", "src", P.heat_signal("src").alias("signal"), P.source_weight("src").alias("weight"))


@query("pool_score", sql("pool", f"WITH {_HEAT} SELECT id, round(score, 6) AS score FROM scored"))
def _(spark, sf):
    return _heat(spark, sf).select("id", F.round(P.pool_score(NOW), 6).alias("score"))


@query("quota_select", sql("pool", f"""WITH {_HEAT}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, id) AS seat, source IN ('src1', 'src2', 'src3') AS depth
        FROM scored WHERE kind = 'news'),
    one AS (SELECT * FROM p WHERE depth AND seat <= 2 ORDER BY round(score, 6) DESC, id LIMIT 40),
    two AS (SELECT * FROM p WHERE id NOT IN (SELECT id FROM one) AND seat <= 6 ORDER BY round(score, 6) DESC, id LIMIT (SELECT 40 - count(*) FROM one))
    SELECT id, source, round(score, 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two)"""))
def _(spark, sf):
    rows = _heat(spark, sf).where("kind = 'news'").withColumn("score", F.round(P.pool_score(NOW), 6))
    return P.quota_select(rows, 40, F.col("source").isin("src1", "src2", "src3")).select("id", "source", "score")


@query("source_caps", sql("pool", """WITH c(source, cap, turn) AS (VALUES ('src5', 20, 1), ('src1', 15, 2), ('src9', 10, 3), ('src2', 15, 4))
    SELECT id, source, turn, place FROM (SELECT pool.*, cap, turn, row_number() OVER (PARTITION BY source ORDER BY coalesce(points, 0) DESC, id) AS place FROM pool JOIN c USING (source))
    WHERE place <= cap ORDER BY turn, place LIMIT 48"""))
def _(spark, sf):
    found = P.source_caps(pool(spark, sf), {"src5": 20, "src1": 15, "src9": 10, "src2": 15}, ["src5", "src1", "src9", "src2"], 48)
    return found.select("id", "source", F.col("turn").cast("int").alias("turn"), F.col("place").cast("long").alias("place"))


@query("latest_batch", sql("pool", "SELECT id, rank FROM pool WHERE kind = 'trending' AND last_seen >= (SELECT max(last_seen) FROM pool WHERE kind = 'trending') - INTERVAL 3 HOUR ORDER BY rank NULLS LAST, id LIMIT 500"))
def _(spark, sf):
    trending = pool(spark, sf).where("kind = 'trending'")
    return P.latest_batch(trending, "2024-01-01 00:00:00").select("id", "rank").limit(500)


@query("history_window", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < TIMESTAMP '1997-06-01' ORDER BY day DESC LIMIT 14)
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT day FROM d)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    days = o.where("day < date '1997-06-01'").select("day").distinct().orderBy(F.desc("day")).limit(14)
    return o.join(F.broadcast(days), "day", "left_semi").select("o_orderkey", "day")


@query("preferred_first", """SELECT page_id, preferred, place FROM (SELECT page_id, contains(url, '.org/') AS preferred, row_number() OVER (ORDER BY contains(url, '.org/') DESC, page_id) AS place
    FROM pages WHERE NOT contains(url, 'blog.')) WHERE place <= 50""")
def _(spark, sf):
    p = table(spark, sf, "pages").where(~F.contains("url", F.lit("blog."))).select("page_id", F.contains("url", F.lit(".org/")).alias("preferred"))
    top = p.orderBy(F.desc("preferred"), "page_id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("preferred"), "page_id")).cast("long"))


@query("excluded_titles", sql("posts", """SELECT post_id, regexp_matches(t, '资源推荐|课程推荐|工具推荐|工具清单|学习路线|报名优惠|限时优惠|训练营报名|(?i:free courses|best (developer )?tools|resource roundup|courses? roundup)') AS excluded
    FROM (SELECT post_id, CASE WHEN post_id % 17 = 0 THEN 'Best Developer Tools ' || title WHEN post_id % 13 = 0 THEN title || '工具清单' ELSE title END AS t FROM posts)"""))
def _(spark, sf):
    t = F.expr("case when post_id % 17 = 0 then concat('Best Developer Tools ', title) when post_id % 13 = 0 then concat(title, '工具清单') else title end")
    return posts(spark, sf).select("post_id", X.excluded_title(t).alias("excluded"))


@query("judge_top4", sql("pool", "SELECT id, total, experiment FROM (SELECT id, coalesce(points, 0) AS total, source = 'src3' AS experiment FROM pool) ORDER BY total DESC, experiment, id LIMIT 4"))
def _(spark, sf):
    p = pool(spark, sf).select("id", F.coalesce("points", F.lit(0)).cast("long").alias("total"), (F.col("source") == "src3").alias("experiment"))
    return p.orderBy(F.desc("total"), "experiment", "id").limit(4)


@query("kept_position", """SELECT page_id, key, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rank FROM
    (SELECT min(page_id) AS page_id, key, split_part(key, '/', 3) AS host FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS key FROM pages) GROUP BY key)""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)).alias("key"))
    first = p.groupBy("key").agg(F.min("page_id").alias("page_id")).withColumn("host", F.split_part("key", F.lit("/"), F.lit(3)))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy("page_id")).cast("long"))


@query("weekly_top", sql("pool", "SELECT source, id, place FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY coalesce(points, 0) DESC, id) AS place FROM pool WHERE kind = 'news') WHERE place <= 12"))
def _(spark, sf):
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.coalesce("points", F.lit(0))), "id"))
    return pool(spark, sf).where("kind = 'news'").withColumn("place", place.cast("long")).where("place <= 12").select("source", "id", "place")
