import public_tokenizers
from pyspark.sql import functions as F

from .common import cut, discard, new_path
from .token_rollup import KEYS, Rollup, count_versions, deletes, inserts, revisions

VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}


def op10_token_rollup(spark, sf_dir):
    """All documents come under every version; their counts are then revised to trimmed texts.

    Documents without a token left are deleted. Every batch is sent twice, which changes nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    counts = count_versions(docs, {version: public_tokenizers.path(file) for version, file in VERSIONS.items()}, public_tokenizers.PATTERN)
    # a row per key and pair of counts, with the number of documents it stands for, is enough for all three batches
    counts = cut(counts.groupBy(*KEYS, "n_tokens", "revised_tokens").agg(F.count(F.lit(1)).alias("times")), "token-counts")
    changed = counts.where("n_tokens <> revised_tokens and revised_tokens > 0")
    batches = {
        "load": inserts(counts),
        "trim": revisions(changed.withColumnsRenamed({"n_tokens": "old_tokens", "revised_tokens": "new_tokens"})),
        "drop": deletes(counts.where("revised_tokens = 0")),
    }
    for name, deltas in batches.items():
        rollup.commit(name, deltas)
        rollup.commit(name, deltas)
    discard(counts)
    rollup.compact()
    return rollup.totals()


QUERIES = {"op10_token_rollup": op10_token_rollup}
ORACLES: dict[str, str] = {}
