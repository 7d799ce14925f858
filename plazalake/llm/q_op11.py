import public_tokenizers

from .word_bpe import word_digest


def op11_word_bpe(spark, sf_dir):
    return word_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_word_bpe": op11_word_bpe}
ORACLES: dict[str, str] = {}
