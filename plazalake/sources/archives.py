"""Event logs and archives of reports and drafts: JSON lines, a folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def append_events(path: str, events: DataFrame) -> None:
    """New rows beside those that are there."""
    events.write.mode("append").json(path)


def archive(path: str, rows: DataFrame, day: str = "day", replace: bool = False) -> None:
    """Rows under their day; a report replaces those of the same days, a rejected draft stands beside earlier ones."""
    out = rows.write.partitionBy(day)
    (out.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else out.mode("append")).json(path)


def archived(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
