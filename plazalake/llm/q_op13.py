from .vector_codes import compress

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def op13_vector_codes(spark, sf_dir):
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=PARTS, entries=ENTRIES, rounds=ROUNDS)


def _round(k: int) -> str:
    """Codebook b{k + 1} from assignments of parts p to b{k}."""
    return f"""
        d{k} AS (SELECT vec_id, row_id, part, entry, list_sum(list_transform(list_zip(p.v, b{k}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN b{k} USING (part)),
        a{k} AS (SELECT row_id, part, min_by(entry, dist * 1000 + entry) AS entry, min(dist) AS dist FROM d{k} GROUP BY ALL),
        m{k} AS (SELECT a.part, a.entry, j, floor(sum(p.v[j]) / count(*)) AS c FROM a{k} a JOIN p USING (row_id, part), range(1, {64 // PARTS + 1}) r(j) GROUP BY ALL),
        b{k + 1} AS (SELECT b.part, b.entry, list(coalesce(m.c::BIGINT, b.v[j]) ORDER BY j) AS v
            FROM b{k} b CROSS JOIN range(1, {64 // PARTS + 1}) r(j) LEFT JOIN m{k} m USING (part, entry, j) GROUP BY ALL)"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {
    "op13_vector_codes": f"""
        WITH t AS (
            SELECT *, row_number() OVER (ORDER BY vec_id) AS row_id FROM (
                SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))),
        p AS (SELECT vec_id, label, row_id, part, x[part * {64 // PARTS} + 1 : (part + 1) * {64 // PARTS}] AS v FROM t, range({PARTS}) r(part)),
        b0 AS (SELECT part, row_id - 1 AS entry, v FROM p WHERE row_id <= {ENTRIES}),
        {_round(0)}, {_round(1)},
        d2 AS (SELECT vec_id, label, row_id, part, entry, list_sum(list_transform(list_zip(p.v, b2.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p JOIN b2 USING (part)),
        a2 AS (SELECT vec_id, label, row_id, part, min_by(entry, dist * 1000 + entry) AS entry, min(dist) AS dist FROM d2 GROUP BY ALL),
        c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY vec_id, label, row_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
        FROM c"""
}
