from pyspark.sql import functions as F

from .wu_manber import decontaminate


def op7_decontaminate(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hits = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return decontaminate(docs, items).select(
        "doc_id",
        "n_words",
        hits.cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {
    "op7_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        p AS (
            SELECT item_id, least(10, len(w)) AS m, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i
            FROM b WHERE len(w) > 0),
        pat AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS pattern FROM p),
        pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
        sizes AS (SELECT DISTINCT m FROM pat),
        win AS (
            SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS pattern
            FROM pos, sizes WHERE i + m - 1 <= len(w)),
        hit AS (SELECT doc_id, i, m, item_id FROM win JOIN pat USING (m, pattern)),
        occ AS (SELECT DISTINCT doc_id, i, m FROM hit),
        words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM occ) GROUP BY 1),
        ids AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""
}
