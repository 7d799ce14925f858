"""Phase 8: operators that need Python in tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.functions import python as Y
from plazalake.functions import text as X
from plazalake.operators import dedup as D
from plazalake.plans.roles import pool
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def _items(spark, sf):
    return pool(spark, sf).select("id", F.col("id").alias("ord"), "url", "title", F.to_date("first_seen").alias("day"), F.substring("title", 1, 20).alias("summary"))


QUERIES["fuzzy_links"] = lambda spark, sf: D.fuzzy_links(_items(spark, sf))
QUERIES["fuzzy_pairs"] = lambda spark, sf: D.title_links(_items(spark, sf))
QUERIES["greedy_dedup"] = lambda spark, sf: D.greedy_dedup(_items(spark, sf))
QUERIES["news_merge"] = lambda spark, sf: D.merge_news(_items(spark, sf))


def pool_upsert_fuzzy(spark, sf):
    """Two thirds of the items as new ones, against a pool with dates and a history of earlier issues."""
    rows = pool(spark, sf).select("id", F.col("id").alias("ord"), "url", "title", "first_seen")
    old, new = rows.where("id % 6 = 0"), rows.where("id % 3 > 0").withColumn("url", F.expr("case when id % 9 = 1 then concat(url, '/../', id) when id % 9 = 2 then regexp_replace(url, '[0-9]+$', cast(id - 2 as string)) else url end"))
    return D.pool_upsert(new.drop("first_seen"), old, rows.where("id % 6 = 3").drop("first_seen"), "2024-01-16 00:00:00")


QUERIES["pool_upsert_fuzzy"] = pool_upsert_fuzzy
QUERIES["lenient_json"] = lambda spark, sf: table(spark, sf, "events").select("event_id", Y.lenient_json(F.concat(F.lit("Answer: "), "props", F.lit(" }. Done"))).alias("json"))
ORACLES["lenient_json"] = "SELECT event_id, props AS json FROM events"
QUERIES["paragraph_cut"] = lambda spark, sf: table(spark, sf, "documents").select("doc_id", X.paragraph_cut(F.col("text"), 1000).alias("text"))
ORACLES["paragraph_cut"] = r"""
    WITH h AS (SELECT doc_id, coalesce(text, '') AS text, left(coalesce(text, ''), 1000) AS head FROM documents),
    p AS (SELECT *, regexp_extract(head, '(?s)\A(.*)\n\n', 1) AS whole FROM h),
    c AS (SELECT doc_id, text, CASE WHEN length(whole) > 500 THEN whole ELSE head END AS head FROM p)
    SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text
        WHEN (length(head) - length(replace(head, '```', ''))) // 3 % 2 = 1 THEN regexp_replace(regexp_extract(head, '(?s)\A(.*)```', 1), '\s+\z', '')
        ELSE head END AS text FROM c"""
QUERIES["markdown_lint"] = lambda spark, sf: table(spark, sf, "pages").select("page_id", Y.markdown_issues("html").alias("issues"))
#: For pages without backticks and tildes in a row: nothing in them is code.
ORACLES["markdown_lint"] = r"""
    SELECT page_id, CASE WHEN html IS NULL OR NOT regexp_matches(html, '\S') THEN ['empty_markdown'] ELSE list_filter([
        CASE WHEN regexp_matches(html, '</?[A-Za-z][\w:-]*(?:\s[^<>]*)?/?>|(?i:\]\(\s*(?:javascript|data|file):)') THEN 'unsupported_markup' END,
        CASE WHEN regexp_matches(html, '(?i)\b(?:TODO|TBD)\b|\[待填[^\]]*\]|\[占位[^\]]*\]') THEN 'editorial_placeholder' END], lambda x: x IS NOT NULL) END AS issues FROM pages"""
QUERIES["metadata_hash"] = lambda spark, sf: table(spark, sf, "events").select("event_id", X.canonical_hash(F.map_from_arrays(F.array(F.lit("type"), F.lit("props")), F.array("event_type", "props"))).alias("digest"))
ORACLES["metadata_hash"] = """SELECT event_id, sha256('{"props":' || coalesce(CAST(to_json(props) AS VARCHAR), 'null') || ',"type":' || coalesce(CAST(to_json(event_type) AS VARCHAR), 'null') || '}') AS digest FROM events"""
