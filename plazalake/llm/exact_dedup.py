"""Exact de-duplication by a tree merge of sorted digest runs.

Every partition of the scan is a run of (digest, best row) pairs. In each round
FAN_IN neighbouring runs meet (a binomial tree has two; sixteen make a quarter of
the rounds): a run's pairs are dealt by a hash of run and digest, and equal digests
of a group of runs are merged by a sorted aggregation that keeps the best row,
until one run is left. Answers go down the same tree, so no join ever meets more than FAN_IN rows of a digest, and
the last one only the rows that one partition holds: a digest that a third of
all rows share is no hot key anywhere.

Built of DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FAN_IN = 16
#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
KEY = ["digest", "check", "size"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, code points and a hash of the text, and what stands for its normalised form.

    SHA-256 is verified by a second hash and the length, all of which must agree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("id", F.char_length("text").alias("chars"), F.xxhash64("text").alias("exact"), F.translate("text", SPACES, "").alias("norm"))
        .select("id", "chars", "exact", F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.octet_length("norm").alias("size"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, text_hash (of the original text).

    Texts are equal if identical without SPACES. The longest original in code
    points stays, then the smallest id, then the smallest text_hash. A null text is
    empty; empty texts form one group. A null id loses against any other; if all ids
    of a group are null, keep_id is null. Rows that repeat an id and its text count in
    group_size and share the verdict. An empty table gives no rows.
    """
    rows = cut(digests(docs, id_col, text_col).withColumn("run", F.spark_partition_id()), "digests")
    order = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("exact").alias("exact"))
    level = cut(rows.groupBy("run", *KEY).agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "runs")
    levels, runs = [level], (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        level = (
            levels[-1]
            .withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        )
        runs = -(-runs // FAN_IN)
        levels.append(cut(level, "runs") if runs > 1 else level)
    answer = levels.pop().select("run", *KEY, "best", "n")
    while levels:
        below = levels.pop().select(F.col("run").alias("child"), F.floor(F.col("run") / FAN_IN).cast("int").alias("run"), *KEY)
        answer = below.join(answer, ["run", *KEY]).select(F.col("child").alias("run"), *KEY, "best", "n")
    return rows.join(answer, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.less")) & (F.col("exact") == F.col("best.exact"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("exact").alias("text_hash"),
    )


def pick(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each id and text_hash in verdicts; null ids are equal."""
    keys = verdicts.select(F.col(id_col).alias("id"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    found = rows.join(keys, rows["own"].eqNullSafe(keys["id"]) & (rows["hash"] == keys["text_hash"]), "left_semi")
    return found.dropDuplicates(["own", "hash"]).select("row.*")
