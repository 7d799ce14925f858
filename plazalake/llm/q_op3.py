import public_tokenizers

from .token_frames import read_bundles, write_bundles

END_ID = 0


def op3_token_frames(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_bundles(write_bundles(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID))


QUERIES = {"op3_token_frames": op3_token_frames}
ORACLES: dict[str, str] = {}
