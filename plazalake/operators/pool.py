"""The content pool: heat, scores, quotas and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a source, 5 for any other.
SOURCE_WEIGHT = {
    "zhihu-hot": 8, "hacker-news": 8, "devto": 8, "sspai": 8,
    "wallstreetcn": 6, "ars-technica": 6, "ieee-spectrum": 6,
    "freecodecamp": 6, "ruanyifeng": 6,
    "lobste-rs": 7, "juejin": 7,
    "the-verge": 6, "techcrunch": 6, "infoq": 6, "oschina": 6,
    "netflix-tech": 8, "cloudflare": 8, "meta-eng": 8, "meituan-tech": 8,
    "nvidia-dev": 8, "nvidia-research": 8, "qwen-blog": 8, "openai-news": 6,
}
DEFAULT_WEIGHT, DEFAULT_HEAT = 5, 50.0
MOST_PER_SOURCE, LEAST_OF_DEPTH = 6, 2


def source_weight(source: str = "source") -> Column:
    pairs = [F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(source)), F.lit(DEFAULT_WEIGHT))


def heat_signal(source: str = "source") -> Column:
    """What a source says of an item's heat; null where it says nothing. 0 points say nothing."""
    points = F.nullif(F.col("points"), F.lit(0)).cast("double")
    place = F.coalesce(F.nullif(F.col("heat"), F.lit(0)).cast("double"), -F.nullif(F.col("rank"), F.lit(0)).cast("double"))
    stars = F.nullif(F.col("today_stars"), F.lit(0)).cast("double")
    return F.when(F.col(source).isin("hacker-news", "devto", "juejin"), points).when(F.col(source) == "zhihu-hot", place).when(F.col(source) == "github-trending", stars)


def rank_heat(rows: DataFrame, signal: str, source: str = "source", tie: str = "id") -> DataFrame:
    """With heat: 0 to 100 by rank of the signal within the source, DEFAULT_HEAT without one. The only one has 100."""
    have = F.col(signal).isNotNull()
    place = F.row_number().over(Window.partitionBy(source, have).orderBy(F.desc(signal), tie))
    n = F.count(signal).over(Window.partitionBy(source))
    scaled = F.when(n == 1, 100.0).otherwise(F.round(100.0 * (n - place) / (n - 1), 1))
    return rows.withColumn("heat", F.when(have, scaled).otherwise(DEFAULT_HEAT))


def pool_score(now: str) -> Column:
    """Heat, the source's weight tenfold, less five for each day since the item was first seen."""
    days = F.expr(f"(unix_micros(cast(timestamp_ntz '{now}' as timestamp)) - unix_micros(cast(first_seen as timestamp))) / 8.64e10")
    return F.col("heat") + 10 * source_weight() - 5 * days


def quota_select(rows: DataFrame, limit: int, depth: Column, score: str = "score", tie: str = "id") -> DataFrame:
    """Up to limit items: LEAST_OF_DEPTH of every depth source come first, the rest by score, MOST_PER_SOURCE of any.

    Windows run per source; what is ordered as a whole is cut to MOST_PER_SOURCE of
    each source before.
    """
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(score), tie))
    few = rows.withColumn("place", place).where(F.col("place") <= MOST_PER_SOURCE)
    few = few.withColumn("first", depth & (F.col("place") <= LEAST_OF_DEPTH))
    return few.orderBy(F.desc("first"), F.desc(score), tie).limit(limit).orderBy(F.desc(score), tie)


def latest_batch(rows: DataFrame, now: str, window_hours: int = 3, stale_hours: int = 48) -> DataFrame:
    """Rows last seen within window_hours of the newest, none if that is older than stale_hours; by rank, null last."""
    newest = rows.agg(F.max("last_seen").alias("newest"))
    found = rows.join(F.broadcast(newest), F.lit(True)).where(
        F.expr(f"last_seen >= newest - interval {window_hours} hours and newest >= timestamp_ntz '{now}' - interval {stale_hours} hours")
    )
    return found.drop("newest").orderBy(F.asc_nulls_last("rank"), "id")


def source_caps(rows: DataFrame, caps: dict[str, int], order: list[str], most: int) -> DataFrame:
    """Up to caps[source] items of each source by points, sources in the given order, most in all."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("source")), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.coalesce("points", F.lit(0))), "id"))
    turn = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    return rows.withColumn("place", place).where(F.col("place") <= cap).withColumn("turn", turn).orderBy("turn", "place").limit(most)
