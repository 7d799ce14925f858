"""Packets and drafts made of documents; each code occurs for some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalake.operators import drafts as D
from plazalake.operators import mirror as M
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


# The same expressions serve Spark and DuckDB; a document is broken in one way for each remainder.
_FIELDS = {
    "body": "CASE WHEN k = 1 THEN '  ' ELSE coalesce(text, '') END",
    "url": "CASE WHEN k = 2 THEN 'ftp://example.com/x' ELSE concat('https://example.com/', doc_id) END",
    "kind": "CASE WHEN k = 3 THEN 'rumour' ELSE 'empirical' END",
    "fatal": "CASE WHEN k = 4 THEN 'truncated' WHEN k = 5 THEN 'short_text' END",
    "status": "CASE WHEN k = 6 THEN 'draft' ELSE 'preprint' END",
    "block": "CASE WHEN k = 7 THEN '' WHEN k = 8 THEN 'words of no source at all' ELSE substring(coalesce(text, ''), 1, 30) END",
    "twin": "CASE WHEN k = 9 THEN 'b1' ELSE 'b2' END",
    "version": "CASE WHEN k = 10 THEN 1 ELSE 2 END",
    "type": "CASE WHEN k = 11 THEN 'promotion' ELSE 'mechanism' END",
    "title": "CASE WHEN k = 12 THEN ' ' WHEN k = 13 THEN 'TODO' ELSE 'A title' END",
    "origin": "CASE WHEN k = 14 THEN 'https://example.com/other' ELSE concat('https://example.com/', doc_id) END",
    "limits": "CASE WHEN k = 15 THEN '' ELSE 'small sample' END",
    "cites": "CASE WHEN k = 16 THEN 'b9' ELSE 'b1' END",
    "quote": "CASE WHEN k = 17 THEN 'never said' ELSE substring(coalesce(text, ''), 3, 9) END",
    "ref": "CASE WHEN k = 18 THEN 'e9' ELSE 'e1' END",
    "markdown": "CASE WHEN k = 19 THEN ' ' WHEN k = 20 THEN concat('~~~', chr(10), 'x') WHEN k = 21 THEN 'a <b>bold</b> word' ELSE 'Plain words.' END",
    "tested": "CASE WHEN k = 22 THEN 'perhaps' WHEN k = 23 THEN 'independently_tested' ELSE 'not_independently_tested' END",
    "hash_of": "CASE WHEN k = 24 THEN 'another text' ELSE CASE WHEN k = 1 THEN '  ' ELSE coalesce(text, '') END END",
}
_MADE = ", ".join(f"{expr} AS {name}" for name, expr in _FIELDS.items())


def _made(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 28).selectExpr("doc_id", "k", *[f"{e} AS {n}" for n, e in _FIELDS.items()])


def _packet(r: DataFrame) -> DataFrame:
    block = F.struct(F.lit("b1").alias("id"), F.col("block").alias("text"))
    twin = F.struct(F.col("twin").alias("id"), F.substring("body", 1, 5).alias("text"))
    proof = F.struct(F.lit("e1").alias("id"), F.col("cites").alias("block_id"), F.lit("It holds.").alias("statement"), F.col("quote").alias("quote"))
    packet = F.struct(
        F.col("body").alias("text"), F.col("url"), F.sha2("hash_of", 256).alias("source_hash"), F.col("kind").alias("evidence_kind"), F.array_compact(F.array("fatal")).alias("issues"),
        F.col("status").alias("publication_status"), F.when(F.col("k") == 25, F.array().cast("array<struct<id:string,text:string>>")).otherwise(F.array(block, twin)).alias("blocks"), F.array(proof).alias("evidence"),
    )
    return r.withColumn("packet", packet.cast(D.PACKET))


_BLANK = "NOT regexp_matches({}, '[^ \\n]')"
_SOURCE = f"""m AS (SELECT *, doc_id % 28 AS k FROM documents), r AS (SELECT doc_id, k, {_MADE} FROM m),
    s AS (SELECT *, [CASE WHEN {_BLANK.format("body")} THEN 'empty_content' WHEN sha256(hash_of) <> sha256(body) THEN 'source_hash_mismatch' END,
        CASE WHEN NOT starts_with(url, 'https://') THEN 'invalid_source_url' END, CASE WHEN kind <> 'empirical' THEN 'invalid_evidence_kind' END,
        CASE WHEN fatal = 'truncated' THEN fatal END, CASE WHEN status = 'draft' THEN 'invalid_publication_status' END] ||
        CASE WHEN k = 25 THEN ['missing_source_blocks'] ELSE [
            CASE WHEN {_BLANK.format("block")} THEN 'invalid_source_block' WHEN NOT contains(body, block) THEN 'unbound_source_block' END,
            CASE WHEN {_BLANK.format("left(body, 5)")} THEN 'invalid_source_block' END,
            CASE WHEN twin = 'b1' AND NOT {_BLANK.format("block")[4:]} IS NULL AND regexp_matches(block, '[^ \\n]') AND regexp_matches(left(body, 5), '[^ \\n]') THEN 'duplicate_source_block' END] END AS codes FROM r)"""
# Codes once each, in the order of their first place.
_ONCE = "array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND list_position(l, x) = i), ',')"


@query("source_issues", f"WITH {_SOURCE} SELECT doc_id, {_ONCE} AS issues FROM (SELECT doc_id, codes AS l FROM s)")
def _(spark, sf):
    return _packet(_made(spark, sf)).select("doc_id", F.array_join(D.source_issues(F.col("packet")), ",").alias("issues"))


# The evidence is bound to the last block of its id: the twin where both are b1.
_HOLDS = "k <> 25 AND cites <> 'b9'"
_QUOTED = "(quote = '' OR contains(CASE WHEN twin = 'b1' THEN left(body, 5) ELSE block END, quote))"


@query("draft_issues", f"""WITH {_SOURCE}, v AS (SELECT *, {_HOLDS} AS holds, {_HOLDS} AND {_QUOTED} AS valid FROM s),
    w AS (SELECT *, valid AND ref = 'e1' AS cited FROM v),
    l AS (SELECT doc_id, codes || [CASE WHEN version <> 2 THEN 'invalid_schema_version' END, CASE WHEN type = 'promotion' THEN 'excluded_article_type' END,
        CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN origin <> url THEN 'draft_source_mismatch' END, CASE WHEN limits = '' THEN 'missing_research_checks' END,
        CASE WHEN NOT holds THEN 'missing_evidence' WHEN NOT valid THEN 'unbound_evidence_quote' END, CASE WHEN NOT cited THEN 'missing_evidence' END] ||
        CASE WHEN k = 26 THEN ['missing_sections'] WHEN trim(markdown) = '' THEN ['invalid_section', 'missing_evidence']
            ELSE [CASE WHEN NOT cited THEN 'missing_evidence' END, CASE WHEN starts_with(markdown, '~~~') THEN 'unclosed_code_fence' END, CASE WHEN contains(markdown, '<b>') THEN 'unsupported_markup' END] END ||
        [CASE WHEN tested = 'perhaps' THEN 'invalid_test_status' WHEN tested = 'independently_tested' THEN 'missing_test_record' END,
        CASE WHEN trim(title) = '' THEN 'empty_markdown' WHEN contains(title, 'TODO') THEN 'editorial_placeholder' END] AS l FROM w)
    SELECT doc_id, {_ONCE} AS issues FROM l""")
def _(spark, sf):
    r = _packet(_made(spark, sf))
    section = F.struct(F.lit("Why").alias("heading"), F.col("markdown"), F.array("ref").alias("evidence_ids"))
    checks = F.create_map(*[F.lit(x) for k in D.CHECKED[:-1] for x in (k, "known")], F.lit("limits"), F.col("limits"))
    words = {n: F.lit("Words.").alias(n) for n in ("learning_question", "opening", "takeaway", "limitation")}
    draft = F.struct(
        F.col("version").alias("schema_version"), F.col("type").alias("article_type"), F.col("title"), *words.values(), F.array().cast("array<string>").alias("prerequisites"),
        F.col("origin").alias("source_url"), F.sha2("hash_of", 256).alias("source_hash"), checks.alias("research_checks"), F.array("ref").alias("evidence_ids"),
        F.when(F.col("k") != 26, F.array(section)).alias("sections"), F.col("tested").alias("test_status"), F.lit(None).cast("string").alias("test_record"),
    )
    r = r.withColumn("draft", draft.cast(D.DRAFT))
    return D.draft_issues(r).select("doc_id", F.array_join("issues", ",").alias("issues"))


@query("combined_decision", """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS p, o_custkey % 4 AS g, o_orderkey % 7 > 0 AS whole FROM orders),
    n AS (SELECT *, CASE p WHEN 0 THEN 'skip_quality' WHEN 1 THEN 'generation_error' WHEN 2 THEN 'done' ELSE 'ready' END AS producer,
        CASE g WHEN 0 THEN 'skip_quality' WHEN 1 THEN 'maybe' ELSE 'ready' END AS gate FROM o)
    SELECT o_orderkey, CASE WHEN g = 1 OR p = 2 THEN 'generation_error' WHEN p < 2 THEN producer WHEN NOT whole THEN 'generation_error' ELSE gate END AS status,
        'said' || CASE WHEN g = 1 THEN ',invalid_gate_result' ELSE ',found' || CASE WHEN p = 2 THEN ',invalid_pipeline_result' WHEN p > 2 AND NOT whole THEN ',malformed_ready_result' ELSE '' END END AS reasons FROM n""")
def _(spark, sf):
    producer = F.expr("case o_orderkey % 5 when 0 then 'skip_quality' when 1 then 'generation_error' when 2 then 'done' else 'ready' end")
    gate = F.expr("case o_custkey % 4 when 0 then 'skip_quality' when 1 then 'maybe' else 'ready' end")
    c = D.combine_decisions(producer, F.array(F.lit("said")), gate, F.array(F.lit("found")), F.col("o_orderkey") % 7 > 0)
    return table(spark, sf, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.status", F.array_join("c.reasons", ",").alias("reasons"))


@query("mirror_articles", """WITH d AS (SELECT doc_id AS id, doc_id % 200 AS n, doc_id % 3 = 0 OR doc_id % 7 = 0 AS bad, doc_id % 2 = 0 AS known, doc_id % 5 > 0 AS ok FROM documents),
    h AS (SELECT *, bad AND known AND ok AND 5 * n - 1 >= 500 AS hit FROM d)
    SELECT id, CASE WHEN hit THEN 5 * n - 1 WHEN id % 3 = 0 THEN 0 ELSE 4 END AS size, CASE WHEN NOT hit THEN 'us' WHEN n % 2 = 0 AND id % 4 = 0 THEN 'them' ELSE 'one' END AS author,
        NOT hit AND id % 7 = 0 AS issue, hit AS via_mirror FROM h""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    captures = d.selectExpr(
        "id", "concat('https://', if(id % 2 = 0, 'mirror', 'other'), '.example.com/articles/', id) as url", "if(id % 3 = 0, '', 'text') as text", "'us' as author",
        "if(id % 7 = 0, array('login_required'), array('short_text')) as issues",
    )
    payload = """concat('{"code": ', if(id % 5 > 0, 20000, 404), ', "data": {"content": "<p>', repeat('word ', cast(id % 200 as int)), '</p>", "author": ', if(id % 4 = 0, '{"display_name": " them "}', '"one"'), '}}')"""
    found = M.with_mirror(captures, d.selectExpr("cast(id as string) as article", f"{payload} as payload"), r"https://mirror\.example\.com/articles/(\d+)")
    return found.select("id", F.char_length("text").alias("size"), "author", F.array_contains("issues", "login_required").alias("issue"), "via_mirror")
