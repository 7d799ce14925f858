from .minhash import near_duplicates


def op5_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "component")


QUERIES = {"op5_near_duplicates": op5_near_duplicates}
ORACLES: dict[str, str] = {}
