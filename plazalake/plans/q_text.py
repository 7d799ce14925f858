"""Phase 5: scalar functions on texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.plans.roles import posts, run_log, sql
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("normalize_url", r"""WITH a AS (SELECT page_id, split_part(trim(url), '#', 1) AS u FROM pages),
    b AS (SELECT page_id, lower(split_part(u, '://', 1)) AS scheme, substr(u, strpos(u, '://') + 3) AS rest FROM a),
    c AS (SELECT page_id, scheme, split_part(rest, '/', 1) AS host, CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/') + 1) ELSE '' END AS tail FROM b),
    d AS (SELECT page_id, scheme, host, rtrim(split_part(tail, '?', 1), '/') AS path, CASE WHEN contains(tail, '?') THEN substr(tail, strpos(tail, '?') + 1) ELSE '' END AS q FROM c),
    e AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN
        ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'ref', 'from', 'spm', 'share_token', 'source', 'fro'))), '&') AS qs FROM d)
    SELECT page_id, scheme || '://' || lower(host) || CASE WHEN path <> '' THEN '/' || path ELSE '' END || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS url FROM e""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))


@query("public_url", r"SELECT page_id, regexp_matches(url, '^(?i:https?)://[^/?#@\s]+([/?#]|$)') AND NOT regexp_matches(url, '[\r\n\t]') AS public FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.public_url(F.col("url")).alias("public"))


@query("extract_keywords", r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_+#.-]{2,}'), lambda x: lower(x)) AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM w),
    f AS (SELECT doc_id, w, min(i) AS i FROM p GROUP BY ALL),
    r AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f)
    SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY place), '') AS keywords FROM documents d LEFT JOIN (SELECT * FROM r WHERE place <= 6) r USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.extract_keywords(F.col("text")), " ").alias("keywords"))


@query("query_cleanup", r"""WITH l AS (SELECT item_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM benchmark),
    c AS (SELECT item_id, i, regexp_replace(x, '^[\s\d.、)\-"''“”]+|[\s"''“”]+$', '', 'g') AS x FROM l),
    r AS (SELECT item_id, x, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM c WHERE length(x) >= 2)
    SELECT b.item_id, coalesce(string_agg(x, '|' ORDER BY place), '') AS lines FROM benchmark b LEFT JOIN (SELECT * FROM r WHERE place <= 3) r USING (item_id) GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.query_lines(F.col("text")), "|").alias("lines"))


@query("chunk_text", """SELECT doc_id, CAST(len(c) AS BIGINT) AS n, sha256(array_to_string(c, '|')) AS digest FROM (SELECT doc_id, CASE WHEN trim(text) = '' THEN []
    WHEN length(text) <= 800 THEN [text] ELSE list_transform(generate_series(0, length(text) - 1, 680), lambda i: substring(text, i + 1, 800)) END AS c FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.chunks(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n"), F.sha2(F.array_join("c", "|"), 256).alias("digest"))


@query("index_payload", """SELECT doc_id, i AS chunk_index, 'post:' || doc_id || ':' || i AS origin_id, md5('post:' || doc_id || ':' || i) AS digest, lang AS partition FROM
    (SELECT doc_id, lang, unnest(generate_series(0, CASE WHEN length(text) <= 800 THEN 0 ELSE (length(text) - 1) // 680 END)) AS i FROM documents WHERE trim(text) <> '')""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("partition"), F.posexplode(X.chunks(F.col("text"))).alias("i", "chunk"))
    origin = F.concat(F.lit("post:"), F.col("doc_id"), F.lit(":"), F.col("i"))
    return d.select("doc_id", F.col("i").cast("long").alias("chunk_index"), origin.alias("origin_id"), F.md5(origin).alias("digest"), "partition")


@query("stable_point_id", "SELECT doc_id, CAST(CAST('0x' || substring(md5('post:' || doc_id), 1, 16) AS UBIGINT) AS VARCHAR) AS point_id FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.stable_id(F.concat(F.lit("post:"), "doc_id")).alias("point_id"))


@query("token_estimate", r"""SELECT doc_id, CAST(o + (length(text) - o + 2) // 3 AS BIGINT) AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("route_model", r"""SELECT doc_id, CASE WHEN o + (length(text) - o + 2) // 3 <= 500 THEN 'small' ELSE 'large' END AS route FROM (SELECT doc_id, text, length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) AS o FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(X.token_estimate(F.col("text")) <= 500, "small").otherwise("large").alias("route"))


@query("score_clamp", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(trunc(least(10, greatest(0, value / 10 - 2))) AS INTEGER) END AS score FROM events")
def _(spark, sf):
    raw = F.expr("case when event_id % 7 = 0 then 'n/a' else cast(value / 10 - 2 as string) end")
    return table(spark, sf, "events").select("event_id", X.score_clamp(raw).alias("score"))


@query("brace_slice", "SELECT event_id, props AS json FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", X.brace_slice(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("json"))


@query("parse_num", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(floor((o_orderkey % 97 || '.5')::DOUBLE * 1000) AS BIGINT) WHEN 1 THEN CAST(floor((o_orderkey % 9 || '.25')::DOUBLE * 1000000) AS BIGINT)
    WHEN 2 THEN 1000 * (o_orderkey % 99) + 123 ELSE 0 END AS n FROM orders""")
def _(spark, sf):
    raw = F.expr("case o_orderkey % 4 when 0 then concat(o_orderkey % 97, '.5k') when 1 then concat(' ', o_orderkey % 9, '.25 M') when 2 then concat(o_orderkey % 99, ',123') else 'many' end")
    return table(spark, sf, "orders").select("o_orderkey", X.parse_num(raw).alias("n"))


@query("strict_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def _(spark, sf):
    raw = F.expr("case o_orderkey % 5 when 0 then date_format(o_orderdate, 'yyyy/MM/dd') when 4 then date_format(o_orderdate, 'yyyy.MM.dd') when 1 then date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") else date_format(o_orderdate, 'yyyy-MM-dd') end")
    return table(spark, sf, "orders").select("o_orderkey", X.strict_date(raw).alias("day"))


@query("local_iso", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS iso FROM events")
def _(spark, sf):
    raw = F.expr("case event_id % 3 when 0 then concat('Mon, ', date_format(ts, 'd MMM yyyy HH:mm:ss'), ' +0000') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") else 'yesterday' end")
    return table(spark, sf, "events").select("event_id", X.local_iso(raw).alias("iso"))


@query("iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.iso_week(F.col("o_orderdate")).alias("week"), F.trunc("o_orderdate", "week").alias("monday"))


@query("theme_day", "SELECT o_orderkey, (['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'])[isodow(o_orderdate)] AS theme FROM orders")
def _(spark, sf):
    names = F.array(*[F.lit(x) for x in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")])
    return table(spark, sf, "orders").select("o_orderkey", F.element_at(names, F.weekday("o_orderdate") + 1).alias("theme"))


def _titles(spark, sf):
    t = F.expr("case post_id % 6 when 0 then concat('《', title, '》') when 1 then concat('3、', title) when 2 then concat('2026-09-12 ', title) when 3 then concat('🚀 ', title, ' ⭐') when 4 then substring(title, 1, 12) else title end")
    return posts(spark, sf).select("post_id", t.alias("t"))


_TITLES = """t AS (SELECT post_id, CASE post_id % 6 WHEN 0 THEN '《' || title || '》' WHEN 1 THEN '3、' || title WHEN 2 THEN '2026-09-12 ' || title
    WHEN 3 THEN '🚀 ' || title || ' ⭐' WHEN 4 THEN substring(title, 1, 12) ELSE title END AS t FROM posts)"""
_EMOJI = r"'[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2B4F}\x{2B51}-\x{2BFF}\x{FE0F}\x{200D}]'"
_DATE = r"'^\s*(?:\d{4}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}\s*日?|\d{1,2}\s*[/.\-月]\s*\d{1,2}\s*日?)\s*[·:：|、,，.．-]?\s*'"


@query("title_clean", sql("posts", rf"""WITH {_TITLES}, a AS (SELECT post_id, regexp_replace(regexp_replace(trim(t), '\s+', ' ', 'g'), {_EMOJI}, '', 'g') AS t FROM t),
    b AS (SELECT post_id, CASE WHEN t LIKE '《%》' THEN trim(substring(t, 2, length(t) - 2)) ELSE t END AS t FROM a),
    c AS (SELECT post_id, regexp_replace(regexp_replace(t, '^\s*(?:第\s*)?\d{{1,2}}\s*[、.．)）:：]\s*', ''), {_DATE}, '') AS t FROM b),
    d AS (SELECT post_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM c)
    SELECT post_id, CASE WHEN length(t) > 30 THEN regexp_replace(substring(t, 1, 29), '[，,。、；;：: !！?？]+$', '') || '…' ELSE t END AS title FROM d"""))
def _(spark, sf):
    return _titles(spark, sf).select("post_id", X.title_clean(F.col("t")).alias("title"))


_RECENT = ["the and of them all", "vour et la les deux"]


@query("title_usable", sql("posts", rf"""WITH {_TITLES} SELECT post_id, CASE WHEN trim(t) = '' THEN 'empty' WHEN length(trim(t)) > 30 THEN 'long' WHEN regexp_matches(trim(t), {_DATE}) THEN 'date' END AS issue FROM t"""))
def _(spark, sf):
    return _titles(spark, sf).select("post_id", X.title_issue(F.col("t"), F.array(*[F.lit(x) for x in _RECENT])).alias("issue"))


@query("title_dice", sql("posts", r"""WITH p AS (SELECT post_id, regexp_replace(title, '\s+', '', 'g') AS a, regexp_replace(substring(body, 20, 40), '\s+', '', 'g') AS b FROM posts),
    g AS (SELECT post_id, list_distinct(list_transform(generate_series(1, greatest(length(a) - 1, 1)), lambda i: substring(a, i, 2))) AS x,
        list_distinct(list_transform(generate_series(1, greatest(length(b) - 1, 1)), lambda i: substring(b, i, 2))) AS y, a, b FROM p)
    SELECT post_id, CASE WHEN a = '' OR b = '' THEN 0 ELSE round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 9) END AS dice FROM g"""))
def _(spark, sf):
    return posts(spark, sf).select("post_id", F.round(X.title_dice(F.col("title"), F.substring("body", 20, 40)), 9).alias("dice"))


_CLEANED = rf"""c1 AS (SELECT *, regexp_replace(regexp_replace(trim(t), '\s+', ' ', 'g'), {_EMOJI}, '', 'g') AS c FROM t),
    c2 AS (SELECT * EXCLUDE (c), CASE WHEN c LIKE '《%》' THEN trim(substring(c, 2, length(c) - 2)) ELSE c END AS c FROM c1),
    c3 AS (SELECT * EXCLUDE (c), trim(regexp_replace(regexp_replace(regexp_replace(c, '^\s*(?:第\s*)?\d{{1,2}}\s*[、.．)）:：]\s*', ''), {_DATE}, ''), '\s+', ' ', 'g')) AS c FROM c2),
    c4 AS (SELECT * EXCLUDE (c), CASE WHEN length(c) > 30 THEN regexp_replace(substring(c, 1, 29), '[，,。、；;：: !！?？]+$', '') || '…' ELSE c END AS c FROM c3),
    hard AS (SELECT *, trim(t) <> '' AND length(trim(t)) <= 30 AND NOT regexp_matches(trim(t), {_DATE}) AS own, c <> trim(t) AND length(trim(t)) <= 30 AND c <> '' AND length(c) <= 30 AND NOT regexp_matches(c, {_DATE}) AS fixed FROM c4)"""


@query("title_ladder", sql("posts", rf"""WITH w AS (SELECT post_id, substring(regexp_replace(title, '[^A-Za-z]+', '', 'g'), 1, 14) AS w FROM posts),
    t AS (SELECT post_id, k, CASE (post_id + k) % 4 WHEN 0 THEN '2026-09-12 ' || w WHEN 1 THEN w || ' and many more words than fit' WHEN 2 THEN '9/12 ' || w || ' and many more words' ELSE '《' || w || '》' END AS t FROM w, range(3) r(k) WHERE length(w) >= 6),
    {_CLEANED}, f AS (SELECT post_id, min(k) FILTER (own OR fixed) AS first FROM hard GROUP BY 1)
    SELECT f.post_id, coalesce(h.c, 'nothing fits') AS title FROM f LEFT JOIN hard h ON h.post_id = f.post_id AND h.k = f.first"""))
def _(spark, sf):
    """Three forms of a title as candidates, with dates and marks around it, some too long; recent titles are tried in tests/test_health.py."""
    w = posts(spark, sf).select("post_id", F.substring(F.regexp_replace("title", "[^A-Za-z]+", ""), 1, 14).alias("w")).where("length(w) >= 6")
    form = lambda k: F.expr(f"case (post_id + {k}) % 4 when 0 then concat('2026-09-12 ', w) when 1 then concat(w, ' and many more words than fit') when 2 then concat('9/12 ', w, ' and many more words') else concat('《', w, '》') end")
    return w.select("post_id", X.title_ladder(F.array(*[form(k) for k in range(3)]), F.array().cast("array<string>"), F.lit("nothing fits")).alias("title"))


@query("headline", sql("posts", r"""SELECT post_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '^[^：:/|]{1,14}[：:/|]', ''), '[…\.]{2,}$', ''), '[，,、；;：:。. ]+$', '')) AS title FROM
    (SELECT post_id, CASE WHEN post_id % 2 = 0 THEN 'News: ' || title || '...' ELSE title END AS title FROM posts WHERE NOT regexp_matches(title, '[()（）\[\]【】|/:…]'))"""))
def _(spark, sf):
    p = posts(spark, sf).where(~F.col("title").rlike(r"[()（）\[\]【】|/:…]"))
    return p.select("post_id", X.headline(F.expr("case when post_id % 2 = 0 then concat('News: ', title, '...') else title end")).alias("title"))


@query("strip_emoji", sql("posts", f"WITH {_TITLES} SELECT post_id, regexp_replace(t, {_EMOJI}, '', 'g') AS t FROM t"))
def _(spark, sf):
    return _titles(spark, sf).select("post_id", X.strip_emoji(F.col("t")).alias("t"))


@query("mostly_signs", r"""SELECT doc_id, n > 0 AND 2 * n >= n + len(regexp_extract_all(text, '[A-Za-z0-9]')) AS mostly FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[à-ÿ]')) AS n FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.mostly_signs(F.col("text"), "à-ÿ").alias("mostly"))


def _bigrams(text: str) -> str:
    return f"list_distinct(flatten(list_transform(regexp_extract_all({text}, '[一-鿿]+'), lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i, 2)))))"


_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)


@query("content_related", sql("posts", rf"""WITH w AS (SELECT post_id, title, substring(body, 1, 200) AS summary, body FROM posts),
    k AS (SELECT *, list_concat(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda x: length(x) >= 4),
        list_transform(list_filter(regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,3}}')), lambda x: lower(x))) AS keys FROM w)
    SELECT post_id, len(list_intersect(list_filter(keys, lambda x: x NOT IN ({_COMMON})), regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+'))) > 0
        OR len(list_intersect({_bigrams("title")}, {_bigrams("body")})) >= 2 OR len(list_intersect({_bigrams("summary")}, {_bigrams("body")})) >= 2 AS related FROM k"""))
def _(spark, sf):
    return posts(spark, sf).select("post_id", X.content_related(F.col("title"), F.substring("body", 1, 200), F.col("body")).alias("related"))


@query("translation_intact", r"""WITH t AS (SELECT doc_id, text AS o, CASE WHEN doc_id % 3 = 0 THEN substring(text, 1, length(text) // 2) ELSE text END AS t FROM documents),
    n AS (SELECT *, regexp_extract_all(o, '\d+(?:\.\d+)?') AS nums FROM t)
    SELECT doc_id, CASE WHEN len(regexp_extract_all(o, '```')) <> len(regexp_extract_all(t, '```')) THEN 'fences'
        WHEN len(regexp_extract_all(t, '\n\n')) + 1 < 0.8::DOUBLE * (len(regexp_extract_all(o, '\n\n')) + 1) THEN 'paragraphs'
        WHEN len(nums) > 0 AND len(list_filter(nums, lambda x: contains(t, x))) < 0.9::DOUBLE * len(nums) THEN 'numbers' END AS issue FROM n""")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", F.expr("case when doc_id % 3 = 0 then substring(text, 1, cast(char_length(text) div 2 as int)) else text end"))
    return d.select("doc_id", X.translation_issue(F.col("text"), F.col("t")).alias("issue"))


@query("refusal", "SELECT conv_id, turn, starts_with(lower(t), 'sorry,') AS refused FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'Sorry, ' || text ELSE text END AS t FROM conversations)")
def _(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.refusal(F.expr("case when turn % 3 = 1 then concat('Sorry, ', text) else text end")).alias("refused"))


@query("error_signature", sql("run_log", r"""SELECT id, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace('at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' user ' || user_id || ' ' || md5(task) || '  ' || detail,
    '\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?', '<ts>', 'g'), '\b[0-9a-fA-F]{12,}\b', '<hex>', 'g'), '\d+', '<n>', 'g'), '\s+', ' ', 'g')), 1, 220) AS signature FROM run_log"""))
def _(spark, sf):
    line = F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" user "), "user_id", F.lit(" "), F.md5("task"), F.lit("  "), "detail")
    return run_log(spark, sf).select("id", X.error_signature(line).alias("signature"))


@query("expected_marker", sql("run_log", "SELECT id, coalesce(tag, '') IN ('publish_dup', 'dry_run_token_ok') AS expected FROM run_log"))
def _(spark, sf):
    return run_log(spark, sf).select("id", X.expected(F.col("tag")).alias("expected"))


@query("ratio_text", "SELECT c_custkey, CASE WHEN d > 0 THEN printf('%d/%d（%.1f%%）', n, d, 100.0::DOUBLE * n / d) ELSE '—' END AS ratio FROM (SELECT c_custkey, c_custkey % 7 AS n, c_custkey % 8 AS d FROM customer)")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.ratio_text(F.col("c_custkey") % 7, F.col("c_custkey") % 8).alias("ratio"))


@query("send_guard", "SELECT o_orderkey, coalesce(date_diff('day', CAST(last AS DATE), DATE '1998-01-01') >= 7, true) AS send FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END AS last FROM orders)")
def _(spark, sf):
    last = F.expr("case when o_orderkey % 9 = 0 then null else o_orderdate end")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.datediff(F.lit("1998-01-01").cast("date"), F.to_date(last)) >= 7, F.lit(True)).alias("send"))


@query("snippet", "SELECT doc_id, sha256(CASE WHEN length(text) > 600 THEN substring(text, 1, 600) || '…' ELSE text END) AS digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.snippet(F.col("text")), 256).alias("digest"))


@query("age_hours", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE round((epoch_us(date_trunc('second', ts)) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9, 6) END AS age FROM events")
def _(spark, sf):
    later = F.expr("date_format(ts, case when event_id % 4 = 0 then \"yyyy-MM-dd'T'HH:mm:ss\" else \"yyyy-MM-dd'T'HH:mm:ss'Z'\" end)")
    return table(spark, sf, "events").select("event_id", F.round(X.age_hours(later, F.lit("2024-01-01T08:00:00+08:00")), 6).alias("age"))


@query("signal_label", sql("pool", "SELECT id, CASE WHEN id % 3 = 0 AND points > 0 THEN printf('%d points', points) WHEN id % 3 = 1 AND rank IS NOT NULL THEN printf('#%d', rank) ELSE '' END AS label FROM pool"))
def _(spark, sf):
    from plazalake.plans.roles import pool

    label = F.when((F.col("id") % 3 == 0) & (F.col("points") > 0), F.format_string("%d points", "points")).when((F.col("id") % 3 == 1) & F.col("rank").isNotNull(), F.format_string("#%d", "rank")).otherwise("")
    return pool(spark, sf).select("id", label.alias("label"))


@query("legacy_compat", sql("pool", "SELECT id, coalesce(nullif(CASE WHEN id % 2 = 0 THEN title END, ''), url) AS name, coalesce(CASE WHEN id % 5 = 0 THEN points END, rank, 0) AS stars FROM pool"))
def _(spark, sf):
    from plazalake.plans.roles import pool

    p = pool(spark, sf).withColumn("trending", F.when(F.col("id") % 5 == 0, F.struct(F.col("points").alias("stars"))))
    return p.select("id", F.coalesce(F.nullif(F.when(F.col("id") % 2 == 0, F.col("title")), F.lit("")), "url").alias("name"), F.coalesce("trending.stars", "rank", F.lit(0)).cast("long").alias("stars"))


@query("unwrap_quotes", sql("posts", "SELECT post_id, trim(title) AS title FROM posts WHERE NOT regexp_matches(title, '[\"''“”‘’「」『』《》]')"))
def _(spark, sf):
    p = posts(spark, sf).where(~F.col("title").rlike("[\"'“”‘’「」『』《》]"))
    return p.select("post_id", X.unwrap(F.concat(F.lit("「"), F.trim("title"), F.lit("」"))).alias("title"))


@query("content_minimum", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]')) >= 300 AS enough FROM documents WHERE NOT contains(text, '```')")
def _(spark, sf):
    d = table(spark, sf, "documents").where(~F.contains("text", F.lit("```")))
    return d.select("doc_id", (X.content_chars(F.col("text")) >= 300).alias("enough"))
