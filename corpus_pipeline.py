"""The corpus pipeline: five stages from documents to encoded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the docs of the next one. All but the last return the
columns of documents. Stages that judge a text by itself pass the rows through;
those that compare texts name the rows that stay by id and a hash of the text, so a
verdict never touches another row with the same id, or with none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazalake.llm.byte_bpe import bpe_encode_decode
from plazalake.llm.common import cut, discard
from plazalake.llm.exact_dedup import exact_dedup, pick
from plazalake.llm.lang_mixture import keep_known, train
from plazalake.llm.minhash import near_duplicates
from plazalake.llm.wu_manber import keep_clean


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told, for want of a text or of letters, go."""
    return keep_known(docs, train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays; so does one of rows that repeat it."""
    return pick(docs, exact_dedup(docs).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, similar by 0.8 or more, stays; all without words do."""
    kept = near_duplicates(docs, percent=80).where("kept")
    one = kept.where("component is not null").groupBy("component", "doc_id").agg(F.min("text_hash").alias("text_hash"))
    return pick(docs, one.select("doc_id", "text_hash").union(kept.where("component is null").select("doc_id", "text_hash")))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, the number of tokens, the ids, and whether they decode to the text."""
    rows = bpe_encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("encode", encode)]
#: SQL has no tokenizer and no mixture of languages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
