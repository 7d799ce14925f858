"""Filters, joins and aggregations over posts, replies and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = "all"


def non_negative(c: str) -> Column:
    """A count as it may come: null or not a number is 0, less than 0 too."""
    return F.greatest(F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0)), F.lit(0)).cast("long")


def recent_unfeatured(posts: DataFrame, now: str, days: int) -> DataFrame:
    since = F.expr(f"timestamp_ntz '{now}' - make_dt_interval({days})")
    return posts.where((F.col("post_time") >= since) & (F.coalesce("featured", F.lit(0)) != 1))


def signal_topn(posts: DataFrame, n: int) -> DataFrame:
    """Unfeatured posts by interaction, the best n; ties by id."""
    signal = F.coalesce("heat", F.lit(0.0)) + 2 * F.col("likes") + 3 * F.col("comments") + 0.1 * F.col("views")
    rest = posts.where(F.coalesce("featured", F.lit(0)) != 1).withColumn("signal", signal)
    return rest.orderBy(F.desc("signal"), "post_id").limit(n)


def visible(posts: DataFrame, partition: str = ALL, exclude: list[int] | None = None) -> DataFrame:
    """Public posts of a partition, or of all, without some ids."""
    found = posts.where(~F.coalesce("is_private", F.lit(False)))
    if partition != ALL:
        found = found.where(F.col("partition") == partition)
    return found.where(~F.col("post_id").isin(exclude)) if exclude else found


def hits_per_post(posts: DataFrame, replies: DataFrame, word: str, n: int) -> DataFrame:
    """Replies to public posts that contain word, counted by post; the n highest, ties by id."""
    hits = replies.where(F.contains(F.lower("body"), F.lit(word.lower()))).select("post_id")
    found = hits.join(visible(posts).select("post_id"), "post_id").groupBy("post_id").agg(F.count(F.lit(1)).alias("hits"))
    return found.orderBy(F.desc("hits"), "post_id").limit(n)


def subreply_hits(posts: DataFrame, replies: DataFrame, subs: DataFrame, word: str, n: int) -> DataFrame:
    found = subs.where(F.contains(F.lower("body"), F.lit(word.lower()))).select("reply_id")
    return hits_per_post(posts, found.join(replies.select("reply_id", "post_id"), "reply_id").withColumn("body", F.lit(word)), word, n)


def pending(posts: DataFrame, answers: DataFrame) -> DataFrame:
    """Posts without an answer that isn't blank."""
    done = answers.where(F.trim(F.coalesce("answer", F.lit(""))) != "").select("post_id")
    return posts.join(done, "post_id", "left_anti")


def top_per_parent(rows: DataFrame, parent: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each parent, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("rank") <= n)


def typed_stats(rows: DataFrame, names: list[str]) -> DataFrame:
    """String cells as longs; a row with a cell that isn't one goes."""
    cast = rows.select([F.expr(f"try_cast({n} as bigint)").alias(n) for n in names])
    return cast.dropna("any")


def publish_allowed(day: str, weekdays: tuple[int, int]) -> Column:
    """Is the day within these weekdays (0 Monday)? A date that can't be read is allowed."""
    d = F.weekday(F.expr(f"try_cast({day} as date)"))
    return F.coalesce(d.between(*weekdays), F.lit(True))


def use_fallback(primary: DataFrame, backup: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """primary, and backup where primary has no rows (of the same keys)."""
    if keys:
        return primary.unionByName(backup.join(primary.select(*keys).distinct(), keys, "left_anti"))
    some = primary.limit(1).select(F.lit(1).alias("_some"))
    return primary.unionByName(backup.join(F.broadcast(some), F.lit(True), "left_anti"))


def saved_answers(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows (answer, references_json, ...) with answer (null if blank), references (none if that isn't a JSON array), used, and listed: the first `most` of them, a line each."""
    one = "array<struct<title:string,url:string>>"
    refs = F.coalesce(F.try_variant_get(F.try_parse_json("references_json"), "$", one), F.array().cast(one))
    line = lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["title"], F.lit("")), F.lit(" → "), F.coalesce(x["url"], F.lit("")))
    found = rows.withColumns({"answer": F.expr("nullif(trim(answer), '')"), "references": refs})
    return found.withColumns({"used": F.size("references").cast("long"), "listed": F.array_join(F.transform(F.slice("references", 1, most), line), "\n")})
