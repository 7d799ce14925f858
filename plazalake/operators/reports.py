"""Aggregated reports: performance windows, weekly tables, log health, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ["ok", "unknown", "warn", "critical"]
EXPECTED_SKIPS = ("weekend", "not_saturday", "publish_dup")
WINDOW_HOURS = (21.0, 24.0, 27.0)
WEIGHTS = {"utility": 0.30, "depth": 0.30, "credibility": 0.25, "audience": 0.10, "novelty": 0.05}


def outcome_kind(status: str = "status", tag: str = "tag") -> Column:
    s, t = F.col(status), F.coalesce(F.col(tag), F.lit(""))
    return (
        F.when((s == "ok") & (t == "published"), "published")
        .when((s == "ok") & (t == "dry_run_token_ok"), "dry_run")
        .when((s == "skipped") & t.isin(*EXPECTED_SKIPS), "expected_skip")
        .when(s == "degraded", "degraded")
        .otherwise("failed")
    )


def access_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """status of requests to the answer service; other lines go."""
    status = F.regexp_extract(value, r'"(?:GET|POST) (/api/v1/assist/[^ "\s]*)[^"]*" (\d{3})', 2)
    return lines.select(status.alias("status")).where("status <> ''").select(F.col("status").cast("int"))


def status_summary(statuses: DataFrame) -> DataFrame:
    """One row: total, ok (2xx), server_errors (from 500), rate in percent (null without requests)."""
    ok, bad = F.count_if(F.col("status").between(200, 299)), F.count_if(F.col("status") >= 500)
    n = F.count(F.lit(1))
    return statuses.agg(n.alias("total"), ok.alias("ok"), bad.alias("server_errors"), F.when(n > 0, F.round(100.0 * ok / n, 2)).alias("rate"))


def nginx_errors(lines: DataFrame, now: str, value: str = "value") -> DataFrame:
    """ts, text of error lines of the answer service; the time in either notation, else now."""
    hit = lines.where(F.contains(value, F.lit("[error]")) & F.contains(value, F.lit("/api/v1/assist/")))
    head = F.substring(F.ltrim(value), 1, 19)
    ts = F.coalesce(F.try_to_timestamp(head, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(head, F.lit("dd/MMM/yyyy:HH:mm:s")), F.lit(now).cast("timestamp"))
    return hit.select(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.substring(value, 1, 400).alias("text"))


def log_errors(lines: DataFrame, since: str, value: str = "value") -> DataFrame:
    """ts, level, text of WARNING and ERROR lines from since on."""
    part = lambda i: F.regexp_extract(value, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ (\w+) (.*)$", i)
    found = lines.select(part(1).alias("ts"), part(2).alias("level"), part(3).alias("text"))
    return found.where(F.col("level").isin("WARNING", "ERROR") & (F.col("ts") >= since))


def error_clusters(entries: DataFrame, signature: Column, expected: Column) -> DataFrame:
    """One row per signature, in the order of input: count, first and last ts, first text."""
    rows = entries.withColumns({"signature": signature, "expected": expected})
    return rows.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("ts", "ord").alias("first_ts"),
        F.max_by("ts", "ord").alias("last_ts"),
        F.min_by(F.substring("text", 1, 300), "ord").alias("sample"),
        F.min_by("expected", "ord").alias("expected"),
    )


def digest_health(log: DataFrame, slots: DataFrame) -> DataFrame:
    """One row: slots, published, expected skips, degraded, rate and status."""
    kind = outcome_kind()
    counts = log.agg(*[F.count_if(kind == k).alias(k) for k in ("published", "expected_skip", "degraded", "failed")])
    both = slots.agg(F.count(F.lit(1)).alias("slots")).join(counts, F.lit(True))
    rate = F.when(F.col("slots") > 0, F.round(100.0 * F.col("published") / F.col("slots"), 2))
    status = F.when(rate.isNull(), "unknown").when(rate >= 100, "ok").when(rate >= 50, "warn").otherwise("critical")
    return both.withColumns({"rate": rate, "health": status})


def expected_slots(days: DataFrame, first: str, last: str) -> DataFrame:
    """day, task: a daily on weekdays, star on Saturdays, weekly on Sundays; days: rows with both dates."""
    day = F.explode(F.sequence(F.col(first), F.col(last), F.expr("interval 1 day"))).alias("day")
    weekday = F.weekday("day")
    return days.select(day).select("day", F.when(weekday == 5, "star").when(weekday == 6, "weekly").otherwise("daily").alias("task"))


def worst(status: str) -> Column:
    """The most severe status of a group."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    return F.max_by(F.col(status), place)


def view_report(samples: DataFrame, posts: DataFrame) -> DataFrame:
    """Of each post the sample nearest to 24 hours, from 21 to 27 hours after publication; the earlier one of a tie.

    Without one, that of the day after the first, marked so; else missing. samples
    (post_id, day, sampled_at, views) meet posts (post_id, published_at) once.
    """
    low, middle, high = WINDOW_HOURS
    rows = samples.join(posts, "post_id", "left")
    age = (F.unix_micros(F.col("sampled_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 3.6e9
    rows = rows.withColumn("age", age)
    near = F.when(F.col("age").between(low, high), F.struct(F.abs(F.col("age") - middle).alias("off"), F.col("age"), F.col("views")))
    first = F.min("day").over(Window.partitionBy("post_id"))
    rows = rows.withColumns({"first_day": first, "near": near})
    next_day = F.when((F.col("day") == F.date_add("first_day", 1)) & F.col("age").isNull(), F.struct("day", "views"))
    out = rows.groupBy("post_id").agg(F.min("near").alias("h"), F.max(next_day).alias("n"), F.min("first_day").alias("day"), F.max_by("views", "sampled_at").alias("current"))
    basis = F.when(F.col("h").isNotNull(), "h24_window").when(F.col("n").isNotNull(), "next_day_approximate").otherwise("missing")
    return out.select("post_id", "day", F.coalesce("h.views", "n.views").alias("h24"), F.col("h.age").alias("age"), basis.alias("basis"), "current")


def split_summary(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """Before and from a day on, by keys: n, measured, missing, mean, median, sums and their ratio."""
    side = F.when(F.col("day") < F.lit(split).cast("date"), "before").otherwise("after")
    return rows.withColumn("side", side).groupBy("side", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("h24").alias("measured"),
        F.count_if(F.col("h24").isNull()).alias("missing"),
        F.avg("h24").alias("mean"),
        F.median("h24").alias("median"),
        F.sum("h24").alias("views"),
        (F.sum(F.when(F.col("h24").isNotNull(), F.col("likes"))) / F.sum("h24")).alias("like_rate"),
    )


def weekly_repos(rows: DataFrame) -> DataFrame:
    """By full_name, rows in order of ord: occurrences, sum and peak of today's stars, most stars, first url, last description."""
    said = (F.coalesce("desc", F.lit("")) != "") & (F.col("desc") != "(无描述)")
    return rows.groupBy("full_name").agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.coalesce("today_stars", F.lit(0))).alias("total_today"),
        F.max(F.coalesce("today_stars", F.lit(0))).alias("peak_today"),
        F.max(F.coalesce("stars", F.lit(0))).alias("stars"),
        F.min_by("url", "ord").alias("url"),
        F.coalesce(F.max(F.when(said, F.struct("ord", "desc")))["desc"], F.lit("")).alias("desc"),
    )


def weighted_score(scores: dict[str, Column]) -> Column:
    """Null unless all five are numbers from 0 to 10."""
    valid, total = F.lit(True), F.lit(0.0)
    for name, weight in WEIGHTS.items():
        v = scores[name].cast("double")
        valid = valid & v.isNotNull() & ~F.isnan(v) & v.between(0, 10)
        total = total + v * weight
    return F.when(valid, F.round(total, 6))


def latest_fields(log: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Of each field the last value that isn't null."""
    return log.groupBy(key).agg(*[F.max(F.when(F.col(f).isNotNull(), F.struct(order, f)))[f].alias(f) for f in fields])


def publish_outcome(weekend: Column, enabled: Column, credentials: Column, duplicate: Column, dry_run: Column, sent: Column) -> Column:
    return (
        F.when(weekend, "weekend").when(~enabled, "disabled").when(~credentials, "no_credentials").when(duplicate, "publish_dup").when(dry_run, "dry_run").when(sent, "published").otherwise("failed")
    )
