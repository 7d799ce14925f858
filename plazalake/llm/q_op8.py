from .warc_bundles import plan_records, read_archives, write_archives


def op8_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = read_archives(write_archives(plan_records(pages)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES: dict[str, str] = {}
