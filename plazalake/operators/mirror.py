"""Captured pages that are of no use, replaced by a mirror's recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalake.operators.blocks import clean_blocks
from plazalake.operators.html import html_blocks

# Fixed values.
VOID = ("empty_content", "login_required", "fulltext_required")
FOUND, LEAST = "20000", 500


def unusable(text: Column, issues: Column) -> Column:
    """Nothing captured, or with an issue that voids it?"""
    void = F.coalesce(F.arrays_overlap(issues, F.array(*[F.lit(i) for i in VOID])), F.lit(False))
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)) | void


def with_mirror(captures: DataFrame, responses: DataFrame, pattern: str) -> DataFrame:
    """captures (id, url, text, author, issues) with via_mirror; an unusable one takes the mirror's text and author.

    pattern finds the article's number in a URL; responses are (article, payload), a JSON answer each
    and one per article. Answers of another code, that can't be read or with under LEAST characters don't count.
    """
    article = F.when(unusable(F.col("text"), F.col("issues")), F.nullif(F.regexp_extract("url", pattern, 1), F.lit("")))
    rows = captures.withColumn("_article", article)
    wanted = rows.select(F.col("_article").alias("article")).where("article is not null").distinct()
    answer = responses.join(wanted, "article", "left_semi").withColumn("v", F.try_parse_json("payload"))
    get = lambda at: F.try_variant_get("v", at, "string")
    name = F.coalesce(get("$.data.author.display_name"), F.when(~F.startswith(get("$.data.author"), F.lit("{")), get("$.data.author")), F.lit(""))
    answer = answer.where(get("$.code") == FOUND).select("article", get("$.data.content").alias("content"), F.trim(name).alias("_author"))
    blocks = clean_blocks(html_blocks(answer, "article", "content").withColumnRenamed("article", "doc"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"])
    texts = blocks.groupBy(F.col("doc").alias("article")).agg(F.array_join(parts, "\n\n").alias("_text")).where(F.char_length("_text") >= LEAST)
    found = texts.join(answer.select("article", "_author"), "article").withColumnRenamed("article", "_article")
    hit = F.col("_text").isNotNull()
    return rows.join(found, "_article", "left").select(
        "id", "url", F.when(hit, F.col("_text")).otherwise(F.col("text")).alias("text"), F.when(hit, F.col("_author")).otherwise(F.col("author")).alias("author"),
        F.when(hit, F.array().cast("array<string>")).otherwise(F.col("issues")).alias("issues"), hit.alias("via_mirror"),
    )
