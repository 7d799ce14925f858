from .toxicity import score, train


def op4_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
