from .context_tree import score_texts


def op6_context_tree(spark, sf_dir):
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_context_tree": op6_context_tree}
ORACLES: dict[str, str] = {}
