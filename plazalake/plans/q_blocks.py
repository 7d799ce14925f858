"""Phase 7: windows over blocks, a paragraph of a document each; HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.operators import blocks as B
from plazalake.operators import html as H
from plazalake.plans.roles import sql  # noqa: F401
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _blocks(spark, sf):
    """Lines of documents; every fifth is a heading, every seventh a list item."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.expr("case when pos % 5 = 0 then 'heading' when pos % 7 = 0 then 'list_item' else 'paragraph' end")
    return d.withColumn("kind", kind).withColumn("level", F.expr("case when pos % 5 = 0 then cast(pos % 3 + 1 as int) end"))


_B = """b AS (SELECT doc, CAST(pos - 1 AS INTEGER) AS pos, text, CASE WHEN (pos - 1) % 5 = 0 THEN 'heading' WHEN (pos - 1) % 7 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind,
    CASE WHEN (pos - 1) % 5 = 0 THEN (pos - 1) % 3 + 1 END AS level
    FROM (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents))"""
_SPAM = """spam AS (SELECT DISTINCT doc, text FROM (SELECT doc, text, pos - lag(pos, 2) OVER (PARTITION BY doc, text ORDER BY pos) AS gap FROM b WHERE kind IN ('paragraph', 'heading') AND length(text) <= 80) WHERE gap <= 15)"""


@query("spam_repeat", f"WITH {_B}, {_SPAM} SELECT doc, text FROM spam")
def _(spark, sf):
    return B.spam_repeats(_blocks(spark, sf))


@query("clean_blocks", f"WITH {_B}, {_SPAM} SELECT doc, pos FROM b LEFT JOIN spam USING (doc, text) WHERE NOT (kind IN ('paragraph', 'heading') AND (spam.doc IS NOT NULL OR (starts_with(text, '> ') AND length(text) <= 80)))")
def _(spark, sf):
    return B.clean_blocks(_blocks(spark, sf)).select("doc", "pos")


@query("budget_cap", f"""WITH {_B}, r AS (SELECT doc, pos, text, 600 - coalesce(sum(length(text) + 2) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b)
    SELECT doc, pos, sha256(substring(text, 1, CAST(room AS INTEGER))) AS digest, length(text) > room AS cut FROM r WHERE room > 0""")
def _(spark, sf):
    return B.budget_cap(_blocks(spark, sf), 600).select("doc", "pos", F.sha2("text", 256).alias("digest"), "cut")


_WORDS = ["method", "the ", "und "]
_PRIORITY = """p AS (SELECT *, contains(lower(text), 'method') OR contains(lower(text), 'the ') OR contains(lower(text), 'und ') AS hit FROM b),
    s AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN CASE WHEN hit THEN 0 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM p),
    pr AS (SELECT doc, pos, text, CASE WHEN coalesce(section, 1) = 0 OR hit THEN 0 ELSE 1 END AS priority FROM s)"""


@query("priority_inherit", f"WITH {_B}, {_PRIORITY} SELECT doc, pos, priority FROM pr")
def _(spark, sf):
    return B.inherit_priority(_blocks(spark, sf), _WORDS).select("doc", "pos", "priority")


@query("evidence_budget", f"""WITH RECURSIVE {_B}, {_PRIORITY}, o AS (SELECT doc, pos, length(text) AS size, row_number() OVER (PARTITION BY doc ORDER BY priority, pos) AS k FROM pr),
    f AS (SELECT doc, k, pos, CASE WHEN size <= 800 THEN size ELSE 0 END AS used, size <= 800 AS selected FROM o WHERE k = 1
        UNION ALL SELECT o.doc, o.k, o.pos, CASE WHEN f.used + o.size <= 800 THEN f.used + o.size ELSE f.used END, f.used + o.size <= 800 FROM f JOIN o ON o.doc = f.doc AND o.k = f.k + 1)
    SELECT doc, pos, selected FROM f""")
def _(spark, sf):
    return B.evidence_budget(B.inherit_priority(_blocks(spark, sf), _WORDS), 800).select("doc", "pos", "selected")


@query("section_present", f"""WITH {_B}, h AS (SELECT doc, pos, level, regexp_matches(text, '[Tt]h|de') AND level <> 1 AS hit FROM b WHERE kind = 'heading'),
    e AS (SELECT h.doc, h.pos, min(n.pos) AS stop FROM h LEFT JOIN h n ON n.doc = h.doc AND n.pos > h.pos AND n.level <= h.level WHERE h.hit GROUP BY ALL),
    f AS (SELECT DISTINCT e.doc FROM e JOIN b ON b.doc = e.doc AND b.pos > e.pos AND (e.stop IS NULL OR b.pos < e.stop) AND b.kind <> 'heading' AND trim(b.text) <> '')
    SELECT d.doc, f.doc IS NOT NULL AS present FROM (SELECT DISTINCT doc FROM b) d LEFT JOIN f USING (doc)""")
def _(spark, sf):
    return B.section_present(_blocks(spark, sf), "[Tt]h|de")


@query("block_issues", f"""WITH {_B}, g AS (SELECT doc, sum(length(text)) AS n, count(*) FILTER (kind = 'heading') AS heads, sum(len(regexp_extract_all(text, '```'))) AS fences FROM b GROUP BY 1)
    SELECT doc, array_to_string(list_filter([CASE WHEN n < 900 THEN 'too_short' END, CASE WHEN heads = 0 THEN 'no_heading' END, CASE WHEN fences % 2 = 1 THEN 'unclosed_fence' END], lambda x: x IS NOT NULL), ',') AS issues FROM g""")
def _(spark, sf):
    return B.block_issues(_blocks(spark, sf), 900).select("doc", F.array_join("issues", ",").alias("issues"))


@query("provenance", f"WITH {_B} SELECT doc, count(*) AS blocks, sha256(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS source_hash FROM b GROUP BY 1")
def _(spark, sf):
    return B.provenance(_blocks(spark, sf))


@query("html_blocks")
def _(spark, sf):
    return H.html_blocks(table(spark, sf, "pages"))


@query("html_meta")
def _(spark, sf):
    return H.html_articles(table(spark, sf, "pages")).select("page_id", F.map_entries("meta").alias("meta"))


@query("html_unescape", r"""SELECT page_id, left(trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')), 300) AS summary FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.clean_html(F.col("html"), 300).alias("summary"))


@query("html_clean_issues")
def _(spark, sf):
    b = H.html_blocks(table(spark, sf, "pages")).withColumnRenamed("page_id", "doc")
    return B.block_issues(B.clean_blocks(b), 500)


@query("article_issues")
def _(spark, sf):
    pages = H.html_articles(table(spark, sf, "pages")).withColumnRenamed("page_id", "doc")
    return B.article_issues(pages, H.LOGIN).select("doc", F.array_join("issues", ",").alias("issues"))
