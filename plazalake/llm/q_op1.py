from .lang_mixture import identify, train


def op1_language_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERIES = {"op1_language_mixture": op1_language_mixture}
ORACLES: dict[str, str] = {}
