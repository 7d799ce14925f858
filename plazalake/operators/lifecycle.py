"""Changes of keyed tables: functions from an old snapshot and changes to a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITABLE = ("assist_responses",)
STAGE_COLUMNS = ("candidate_score", "notes", "draft", "review")


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one of the highest version; new rows beat old ones of the same."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max(F.struct(version, "_new", *[c for c in rest if c not in (version, "_new")])).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}") for c in rest if c != "_new"])


def issue_numbers(old: DataFrame, new: DataFrame, key: str, first: int, coarse: Column) -> DataFrame:
    """New keys take numbers from `first` on in order of key; known keys keep theirs, and their title if the new one is empty.

    coarse: a value of the key that keeps its order, such as its month. New keys of
    one value are ordered in one task; the counts of values alone are ordered as a whole.
    """
    fresh = new.join(old.where("issue_no is not null"), key, "left_anti").select(key, coarse.alias("_coarse"))
    before = F.sum("n").over(Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1))
    counts = fresh.groupBy("_coarse").agg(F.count(F.lit(1)).alias("n")).select("_coarse", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_coarse").orderBy(key))
    dealt = fresh.join(counts, "_coarse").select(key, (place + F.col("_before") + (first - 1)).cast("long").alias("dealt"))
    o = old.select(key, F.col("issue_no").alias("_no"), F.col("title").alias("_title"))
    joined = new.join(o, key, "left").join(dealt, key, "left")
    return joined.select(key, F.coalesce("_no", "dealt").alias("issue_no"), F.coalesce(F.nullif("title", F.lit("")), "_title").alias("title"))


def point_update(old: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """column of the changed keys replaced; keys that old lacks are ignored."""
    c = changes.select(key, F.col(column).alias("_value"), F.lit(True).alias("_hit"))
    return old.join(c, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_value")).otherwise(F.col(column))).drop("_value", "_hit")


def conditional_upsert(old: DataFrame, new: DataFrame, key: str, guard: str) -> DataFrame:
    """A row of new replaces that of old, unless its guard column is null or empty; then old stays as it is."""
    columns = [c for c in old.columns if c != key]
    o = old.select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = o.join(new, key, "full_outer")
    keep = F.col("_old") & (F.coalesce(F.col(guard), F.lit("")) == "")
    return joined.select(key, *[F.when(F.coalesce(keep, F.lit(False)), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def increment(old: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """The counter plus the sum of events of the same key; events of unknown keys are ignored."""
    add = events.groupBy(key).agg(F.sum("delta").alias("_add"))
    return old.join(add, key, "left").withColumn(counter, F.col(counter) + F.coalesce("_add", F.lit(0))).drop("_add")


def pool_upsert_exact(pool: DataFrame, items: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Pool with known (kind, url) refreshed, and the items that are new; of items with one url the first by ord counts."""
    first = items.groupBy("kind", "url").agg(F.min_by(F.struct(*[c for c in items.columns if c not in ("kind", "url")]), "ord").alias("i"))
    seen = first.select("kind", "url", F.lit(True).alias("_hit"), F.col("i.points").alias("_points"))
    stamp = F.expr(f"timestamp_ntz '{now}'")
    fresh = pool.join(seen, ["kind", "url"], "left").withColumns(
        {"last_seen": F.when(F.col("_hit"), stamp).otherwise(F.col("last_seen")), "points": F.coalesce("_points", "points")}
    )
    return fresh.drop("_hit", "_points"), first.join(pool.select("kind", "url"), ["kind", "url"], "left_anti").select("kind", "url", "i.*")


def stage_write(pool: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    if column not in STAGE_COLUMNS:
        raise ValueError(f"{column} isn't a stage column")
    return point_update(pool, changes, "url", column)


def write_allowed(table: str) -> str:
    if table not in WRITABLE:
        raise ValueError(f"{table} isn't writable")
    return table


def transition(pool: DataFrame, urls: DataFrame, status_from: str, status_to: str) -> DataFrame:
    """News rows of these urls go from one status to another; rows in any other status stay."""
    hit = urls.select("url").distinct().withColumn("_hit", F.lit(True))
    move = F.col("_hit") & (F.col("status") == status_from) & (F.col("kind") == "news")
    return pool.join(hit, "url", "left").withColumn("status", F.when(move, status_to).otherwise(F.col("status"))).drop("_hit")


def sweep(pool: DataFrame, now: str, candidate_days: int, reserved_days: int, keep_days: int, trending_days: int) -> DataFrame:
    """With `before` (the status until now) and status: expired, deleted or as it was.

    The steps follow each other: a candidate that is also past keep_days expires and goes.
    """
    older = lambda days: F.expr(f"last_seen < timestamp_ntz '{now}' - interval {days} days")
    news = F.col("kind") == "news"
    aged = F.when(news & (F.col("status") == "candidate") & older(candidate_days), "expired").when(news & (F.col("status") == "reserved") & older(reserved_days), "expired").otherwise(F.col("status"))
    gone = (news & (F.col("aged") == "expired") & older(keep_days)) | (~news & older(trending_days))
    return pool.withColumn("before", F.col("status")).withColumn("aged", aged).withColumn("status", F.when(gone, "deleted").otherwise(F.col("aged"))).drop("aged")


def active_cooldowns(events: DataFrame, hours: int, now: str, refused: Column) -> DataFrame:
    """source, until: of sources that refused, still in their time."""
    until = events.where(refused).groupBy("source").agg((F.max("ts") + F.expr(f"interval {hours} hours")).alias("until"))
    return until.where(F.col("until") > F.expr(f"timestamp_ntz '{now}'"))


def retain(log: DataFrame, since: str, most: int, kept_by_date: Column) -> DataFrame:
    """Rows kept by date if not older than since; of the others the newest `most`."""
    by_date = log.where(kept_by_date & (F.col("ts") >= F.expr(f"timestamp_ntz '{since}'")))
    newest = log.where(~F.coalesce(kept_by_date, F.lit(False))).orderBy(F.desc("id")).limit(most)
    return by_date.unionByName(newest)


def delete_counted(points: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Points without these keys, and how many there were, are and went."""
    left = points.join(gone.select(key).distinct(), key, "left_anti")
    before, after = points.agg(F.count(F.lit(1)).alias("before")), left.agg(F.count(F.lit(1)).alias("after"))
    return left, before.join(after, F.lit(True)).withColumn("deleted", F.col("before") - F.col("after"))


def backfill(decisions: DataFrame, ids: DataFrame) -> DataFrame:
    """marked of featured rows of these posts that weren't marked."""
    hit = ids.select("post_id").distinct().withColumn("_hit", F.lit(True))
    mark = F.col("featured") & ~F.coalesce("marked", F.lit(False)) & F.col("_hit")
    return decisions.join(hit, "post_id", "left").withColumn("marked", F.when(mark, True).otherwise(F.col("marked"))).drop("_hit")


def fresh_cache(rows: DataFrame, kind: str, day: str, version: str) -> Column:
    """Is a cached stage of this kind, day, rubric version and source?"""
    return (F.col("kind") == kind) & (F.col("day") == day) & (F.col("version") == version) & (F.col("hash") == F.col("source_hash"))
