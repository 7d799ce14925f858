"""Service logs, disk and certificate probes, retrieval hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a service line an error, and what is expected.
ERROR_MARKS = ("失败", "异常", "错误", "ERROR", "Traceback", "Timeout", "refused")
EXPECTED_LINES = ("INFO:", "[llm] 主通道（market-deploy）失败，尝试备用通道")
RAG_SOURCE = r"^market_(\d+)\.txt$"
RAG_MOST = 5


def _has(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def service_errors(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with an error mark and none that is expected; file headings and blank lines go."""
    s = F.trim(F.col(value))
    keep = (s != "") & ~F.startswith(s, F.lit("==")) & _has(s, ERROR_MARKS) & ~_has(s, EXPECTED_LINES)
    return lines.where(keep).withColumn(value, F.substring(s, 1, 400))


def disk_rows(text: DataFrame, value: str = "value") -> DataFrame:
    """With size, used, percent of the second line that isn't blank of a disk report; rows without go."""
    line = F.get(F.filter(F.split(value, "\n"), lambda x: F.trim(x) != ""), F.lit(1))
    parts = F.split(F.trim(line), r"\s+")
    found = text.withColumns({"size": F.get(parts, 1), "used": F.get(parts, 2), "percent": F.rtrim(F.get(parts, 4), F.lit("%")).try_cast("int")})
    return found.where((F.size(parts) >= 6) & F.col("percent").isNotNull())


def certificate_end(line: Column) -> Column:
    """The time after notAfter=; null if there is none."""
    raw = F.regexp_replace(F.trim(F.regexp_extract(line, r"=(.*)$", 1)), r"\s+", " ")
    return F.try_to_timestamp(F.regexp_replace(raw, " GMT$", " +0000"), F.lit("MMM d HH:mm:ss yyyy Z"))


def rag_hits(hits: DataFrame, k: int) -> DataFrame:
    """query_id, post_id, score of hits (query_id, rank, source) whose source names a post; k between 1 and RAG_MOST."""
    post = F.regexp_extract("source", RAG_SOURCE, 1).try_cast("long")
    found = hits.select("query_id", "rank", post.alias("post_id")).where("post_id is not null")
    return found.where(F.col("rank") <= max(1, min(RAG_MOST, k))).select("query_id", "post_id", F.round(1 / F.col("rank"), 4).alias("score"))
