from .whitening import whiten


def op12_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
