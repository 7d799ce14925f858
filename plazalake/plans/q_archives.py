"""Appended events, archives, full syncs, readers and exclusion lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.operators import relational as R
from plazalake.operators import retrieval as V
from plazalake.plans.roles import posts, replies, sql
from plazalake.sources import archives as A
from plazalake.sources import feeds
from plazalake.sources.shared import place
from plazalake.sources.tables import json_lines, parquet_or_empty, table
from plazalake.streaming import jobs as J

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


_WORDS = ["the", "die", "la", "data"]


@query("posts_per_word", sql("posts", """SELECT word, post_id, CAST(score AS INTEGER) AS score, heat, rank FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, heat DESC, post_id) AS rank FROM
    (SELECT word, post_id, coalesce(heat, 0) AS heat, 2 * CAST(contains(lower(coalesce(title, '')), word) AS INTEGER) + CAST(contains(lower(coalesce(body, '')), word) AS INTEGER) AS score
    FROM posts, (SELECT unnest(['the', 'die', 'la', 'data']) AS word) WHERE NOT is_private) WHERE score > 0) WHERE rank <= 30"""))
def _(spark, sf):
    return V.keyword_posts(posts(spark, sf), _WORDS, 30)


@query("append_events", "SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id + 1000000000, event_type, value FROM events WHERE event_type = 'error'")
def _(spark, sf):
    e, path = table(spark, sf, "events").select("event_id", "event_type", "value"), place(spark, "events")
    A.append_events(path, e)
    A.append_events(path, e.where("event_type = 'error'").withColumn("event_id", F.col("event_id") + 1_000_000_000))
    return A.archived(spark, path, e.schema)


@query("report_archive", "SELECT strftime(o_orderdate, '%Y-%m') AS day, o_orderstatus AS status, count(*) AS orders, CASE WHEN year(o_orderdate) = 1995 THEN 'late' ELSE 'early' END AS version FROM orders GROUP BY ALL")
def _(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders")).withColumn("version", F.lit("early"))
    path = place(spark, "reports")
    A.archive(path, rows, replace=True)
    A.archive(path, rows.where("day like '1995%'").withColumn("version", F.lit("late")), replace=True)
    return A.archived(spark, path, rows.schema)


@query("draft_archive", "SELECT strftime(o_orderdate, '%Y-%m') AS day, o_orderkey AS draft, 'skip_quality' AS status FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_orderkey, 'generation_error' FROM orders WHERE o_orderstatus = 'P'")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    rejected = lambda where, status: o.where(where).select("day", F.col("o_orderkey").alias("draft"), F.lit(status).alias("status"))
    path = place(spark, "drafts")
    A.archive(path, rejected("o_orderstatus <> 'F'", "skip_quality"))
    A.archive(path, rejected("o_orderstatus = 'P'", "generation_error"))
    return A.archived(spark, path, rejected("true", "").schema)


@query("full_sync_marks", sql("posts replies", "SELECT 'posts' AS source, max(post_time) AS mark FROM posts WHERE NOT is_private UNION ALL SELECT 'replies', TIMESTAMP '2024-01-02' UNION ALL SELECT 'none', TIMESTAMP '1970-01-01'"))
def _(spark, sf):
    known = spark.range(1).selectExpr("'replies' as source", "timestamp_ntz '2024-01-02 00:00:00' as mark")
    p = posts(spark, sf).where("not is_private").withColumn("time", F.col("post_time"))
    return J.first_marks(known, {"posts": p, "replies": replies(spark, sf), "none": p.where("false")})


@query("optional_table", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, CAST(NULL AS VARCHAR) AS note FROM customer")
def _(spark, sf):
    """Parts of a table written by two versions, of which the older had no balance; a column that none has; a table that isn't there."""
    c, path = table(spark, sf, "customer"), place(spark, "versions")
    c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.mode("append").parquet(path)
    c.where("c_custkey % 2 = 1").select("c_custkey", "c_name").write.mode("append").parquet(path)
    schema = "c_custkey long, c_name string, c_acctbal double, note string"
    return parquet_or_empty(spark, path, schema).unionByName(parquet_or_empty(spark, f"{path}-none", schema))


@query("json_lines", "SELECT event_id, event_type FROM events WHERE event_id % 5 > 0")
def _(spark, sf):
    e, path = table(spark, sf, "events"), place(spark, "lines")
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    e.select(line.alias("value")).write.text(path)
    return json_lines(spark, path, e.select("event_id", "event_type").schema)


@query("feed_caps", "SELECT source, doc_id, pos FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, dense_rank() OVER (ORDER BY source) * 7 AS cap FROM documents) WHERE pos <= cap")
def _(spark, sf):
    from pyspark.sql import Window

    d = table(spark, sf, "documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("pos"))
    caps = d.select("source").distinct().withColumn("cap", F.row_number().over(Window.orderBy("source")) * 7)
    return feeds.capped(d, caps)


_LIFE = "(?i)license|copyright"


def _titles(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("feed"), "doc_id", F.col("text").alias("title"))


_MARKED = f"m AS (SELECT source AS feed, doc_id, coalesce(regexp_matches(text, '{_LIFE}'), false) AS hit FROM documents), k AS (SELECT feed, doc_id, row_number() OVER (PARTITION BY feed ORDER BY doc_id) AS n FROM m WHERE NOT hit)"


@query("feed_filter", f"WITH {_MARKED}, e AS (SELECT feed, doc_id AS last FROM k WHERE n = 20) SELECT m.feed, count(*) FILTER (hit AND (last IS NULL OR doc_id < last)) AS skipped FROM m LEFT JOIN e USING (feed) GROUP BY 1")
def _(spark, sf):
    return feeds.filtered(_titles(spark, sf), _LIFE, 20, ("doc_id",))[1]


@query("feed_filter_items", f"WITH {_MARKED} SELECT feed, doc_id FROM k WHERE n <= 20")
def _(spark, sf):
    return feeds.filtered(_titles(spark, sf), _LIFE, 20, ("doc_id",))[0].select("feed", "doc_id")


@query("excluded_posts", sql("posts", "SELECT post_id FROM posts WHERE NOT is_private AND post_id NOT IN (3, 5, 8)"))
def _(spark, sf):
    return R.visible(posts(spark, sf), exclude=[3, 5, 8]).select("post_id")
