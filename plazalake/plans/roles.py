"""The driver's tables in the roles of forum, feed and log tables.

A document has no title: its first 40 characters stand for one, its whole text is the body.
Each role is a projection of a whole table: a function here, and the same as a
DuckDB common table expression in CTE for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalake.sources.tables import table

NOW = "2024-01-31 00:00:00"


def at_minute(minutes: str) -> F.Column:
    return F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({minutes} as int))")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("post_id"),
        F.col("lang").alias("partition"),
        F.substring("text", 1, 40).alias("title"),
        F.col("text").alias("body"),
        F.col("n_chars").cast("double").alias("heat"),
        at_minute("doc_id % 43200").alias("post_time"),
        (F.col("doc_id") % 150).alias("user_id"),
        F.expr("case when doc_id % 7 = 0 then 1 when doc_id % 5 = 0 then null else 0 end").alias("featured"),
        (F.col("doc_id") % 11 == 0).alias("is_private"),
        (F.col("doc_id") % 1009).alias("views"),
        (F.col("doc_id") % 97).alias("likes"),
        (F.col("doc_id") % 13).alias("comments"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn > 0")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"),
        F.col("conv_id").alias("post_id"),
        F.col("text").alias("body"),
        (F.char_length("text") % 50).cast("long").alias("likes"),
        at_minute("conv_id % 43200 + turn").alias("time"),
    )


def subreplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("turn > 1")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn") + 500).alias("sub_id"),
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("reply_id"),
        F.col("text").alias("body"),
        (F.char_length("text") % 30).cast("long").alias("likes"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News pool: a document each."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.expr("case when doc_id % 4 = 3 then 'trending' else 'news' end").alias("kind"),
        F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.col("source"),
        F.substring("text", 1, 40).alias("title"),
        F.expr("case when doc_id % 6 = 5 then null else n_chars % 500 end").alias("points"),
        F.expr("element_at(array('candidate', 'candidate', 'reserved', 'daily_used', 'expired'), cast(doc_id % 5 + 1 as int))").alias("status"),
        at_minute("doc_id * 7 % 43200").alias("first_seen"),
        at_minute("doc_id * 7 % 43200 + doc_id % 90").alias("last_seen"),
        F.expr("case when doc_id % 4 = 3 then cast(doc_id % 30 as int) end").alias("rank"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = "case event_type when 'purchase' then 'ok' when 'view' then 'ok' when 'click' then 'skipped' when 'error' then 'degraded' else 'failed' end"
    tag = "case event_type when 'purchase' then 'published' when 'view' then 'dry_run_token_ok' when 'click' then element_at(array('weekend', 'publish_dup', 'manual'), cast(event_id % 3 + 1 as int)) end"
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.expr("element_at(array('daily', 'star', 'weekly'), cast(user_id % 3 + 1 as int))").alias("task"),
        F.expr(status).alias("status"),
        F.expr(tag).alias("tag"),
        F.col("props").alias("detail"),
        F.col("value"),
        F.col("user_id"),
        F.col("event_type"),
    )


CTE = {
    "posts": """posts AS (SELECT doc_id AS post_id, lang AS partition, substring(text, 1, 40) AS title, text AS body,
        CAST(n_chars AS DOUBLE) AS heat, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id % 43200 AS INTEGER)) AS post_time,
        doc_id % 150 AS user_id, CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN NULL ELSE 0 END AS featured,
        doc_id % 11 = 0 AS is_private, doc_id % 1009 AS views, doc_id % 97 AS likes, doc_id % 13 AS comments FROM documents)""",
    "replies": """replies AS (SELECT conv_id * 1000 + turn AS reply_id, conv_id AS post_id, text AS body,
        CAST(length(text) % 50 AS BIGINT) AS likes, TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id % 43200 + turn AS INTEGER)) AS time
        FROM conversations WHERE turn > 0)""",
    "subreplies": """subreplies AS (SELECT conv_id * 1000 + turn + 500 AS sub_id, conv_id * 1000 + turn - 1 AS reply_id, text AS body,
        CAST(length(text) % 30 AS BIGINT) AS likes FROM conversations WHERE turn > 1)""",
    "pool": """pool AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'trending' ELSE 'news' END AS kind,
        'https://example.com/' || source || '/' || doc_id AS url, source, substring(text, 1, 40) AS title,
        CASE WHEN doc_id % 6 = 5 THEN NULL ELSE n_chars % 500 END AS points,
        (['candidate', 'candidate', 'reserved', 'daily_used', 'expired'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS status,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7 % 43200 AS INTEGER)) AS first_seen,
        TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 7 % 43200 + doc_id % 90 AS INTEGER)) AS last_seen,
        CASE WHEN doc_id % 4 = 3 THEN CAST(doc_id % 30 AS INTEGER) END AS rank FROM documents)""",
    "run_log": """run_log AS (SELECT event_id AS id, ts, (['daily', 'star', 'weekly'])[CAST(user_id % 3 + 1 AS INTEGER)] AS task,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'degraded' ELSE 'failed' END AS status,
        CASE event_type WHEN 'purchase' THEN 'published' WHEN 'view' THEN 'dry_run_token_ok'
            WHEN 'click' THEN (['weekend', 'publish_dup', 'manual'])[CAST(event_id % 3 + 1 AS INTEGER)] END AS tag,
        props AS detail, value, user_id, event_type FROM events)""",
}


def sql(roles: str, query: str) -> str:
    """An oracle over roles, named with spaces between."""
    ctes = ", ".join(CTE[r] for r in roles.split())
    head, rest = ("", query.strip())
    if rest[:5].upper() == "WITH ":
        return f"WITH {ctes}, {rest[5:]}"
    return f"WITH {ctes} {head}{rest}"
