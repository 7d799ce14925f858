"""Phases 9 and 10: recorded payloads, and what streams compute, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.operators import relational as R
from plazalake.plans.roles import pool, posts, replies, sql
from plazalake.sources import feeds as S
from plazalake.sources.shared import place
from plazalake.sources.tables import probe_values, table, tsv_rows
from plazalake.streaming import jobs as J
from plazalake.streaming.index import Index

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("tsv_rows", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return tsv_rows(table(spark, sf, "customer").select(F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value")), ["id", "name", "segment"])


@query("probe_values", "SELECT 'PROC' AS name, user_id AS number FROM events WHERE user_id % 2 = 0")
def _(spark, sf):
    e = table(spark, sf, "events")
    return probe_values(e.select(F.expr("case when user_id % 2 = 0 then concat('PROC=', user_id) else 'down' end").alias("value")))


def _hits(spark, sf):
    """A payload per customer: its orders as hits."""
    hit = F.to_json(F.struct(F.concat(F.lit("story "), "o_orderkey").alias("title"), F.expr("case when o_orderkey % 7 > 0 then concat('https://e.com/', o_orderkey) end").alias("url"), (F.col("o_orderkey") % 60).alias("points"), F.lit("a").alias("author")))
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("feed")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", hit.alias("h")))).alias("hs"))
    return rows.select("feed", F.concat(F.lit('{"hits":['), F.array_join(F.transform("hs", lambda x: x["h"]), ","), F.lit("]}")).alias("payload"))


@query("news_hits", """SELECT feed, title, url, points FROM (SELECT o_custkey AS feed, 'story ' || o_orderkey AS title, 'https://e.com/' || o_orderkey AS url, o_orderkey % 60 AS points,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 60 >= 20) WHERE n <= 15""")
def _(spark, sf):
    return S.news_hits(_hits(spark, sf)).select("feed", "title", "url", "points")


@query("story_items", "SELECT event_id AS feed, 't' || event_id AS title, value::BIGINT AS points FROM (SELECT event_id, floor(value) AS value FROM events) WHERE event_id % 3 = 0 AND event_id % 5 > 0 AND value >= 20")
def _(spark, sf):
    e = table(spark, sf, "events")
    story = F.to_json(F.struct(F.expr("case when event_id % 3 = 0 then 'story' else 'job' end").alias("type"), F.concat(F.lit("t"), "event_id").alias("title"), F.lit("https://e.com").alias("url"), (F.col("event_id") % 5 == 0).alias("dead"), F.floor("value").alias("score"), F.lit(1704067200).alias("time")))
    return S.story_items(e.select(F.col("event_id").alias("feed"), story.alias("payload"))).select("feed", "title", "points")


@query("ranked_articles", "SELECT o_orderkey AS feed, 'https://juejin.cn/post/' || o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE 7 END AS points FROM orders WHERE o_orderkey % 4 > 0 AND o_custkey > 0")
def _(spark, sf):
    o = table(spark, sf, "orders").where("o_custkey > 0")
    info = F.struct(F.col("o_orderkey").cast("string").alias("article_id"), F.lit("t").alias("title"), F.expr("case when o_custkey % 2 = 0 then o_custkey else 0 end").alias("hot_index"), F.lit(7).alias("view_count"))
    payload = F.to_json(F.struct(F.expr("case when o_orderkey % 4 > 0 then 0 else 1 end").alias("err_no"), F.array(F.struct(F.struct(info.alias("article_info")).alias("item_info"))).alias("data")))
    return S.ranked_articles(o.select(F.col("o_orderkey").alias("feed"), payload.alias("payload"))).select("feed", "url", "points")


@query("flow_articles", "SELECT event_id AS feed, 'n' || event_id AS title FROM events WHERE event_type = 'view' AND user_id % 2 = 0")
def _(spark, sf):
    e = table(spark, sf, "events")
    res = F.struct(F.concat(F.lit("n"), "event_id").alias("title"), F.lit("https://w.com/a").alias("uri"), (F.col("user_id") % 2 == 1).alias("is_paid"), F.lit(1704067200).alias("display_time"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.expr("case when event_type = 'view' then 'article' else 'live' end").alias("resource_type"), res.alias("resource"))).alias("items")).alias("data")))
    return S.flow_articles(e.select(F.col("event_id").alias("feed"), payload.alias("payload"))).select("feed", "title")


@query("articles", "SELECT event_id AS feed, 'd' || event_id AS title, user_id AS points FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    item = F.to_json(F.array(F.struct(F.concat(F.lit("d"), "event_id").alias("title"), F.lit("https://d.to/x").alias("url"), F.col("user_id").alias("positive_reactions_count"))))
    return S.articles(e.select(F.col("event_id").alias("feed"), item.alias("payload"))).select("feed", "title", "points")


@query("api_json_parse", "SELECT s_suppkey AS feed, 'org/r' || n_nationkey AS full_name, n_nationkey + 1 AS rank, n_nationkey * s_suppkey AS stars FROM supplier, nation WHERE n_nationkey % 5 > 0")
def _(spark, sf):
    n = table(spark, sf, "nation").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    s = table(spark, sf, "supplier").join(F.broadcast(n), F.lit(True))
    items = F.transform("ks", lambda k: F.struct(F.concat(F.lit("org/r"), k).alias("full_name"), (k * F.col("s_suppkey")).alias("stargazers_count")))
    seen = table(spark, sf, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("org/r"), "n_nationkey").alias("full_name"))
    found = S.repositories(s.select(F.col("s_suppkey").alias("feed"), F.to_json(F.struct(items.alias("items"))).alias("payload")), seen)
    return found.select("feed", "full_name", F.col("rank").cast("int").alias("rank"), "stars")


@query("embedding_shapes", "SELECT vec_id AS feed, 0 AS pos, list_transform(embedding, lambda x: round(x::DOUBLE, 5)) AS vector FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    rounded = lambda x: F.round(x.cast("double"), 5)  # noqa: E731  of what is a little below zero it would be a positive one
    v = F.transform("embedding", lambda x: F.when((x < 0) & (rounded(x) == 0), F.lit(-0.0)).otherwise(rounded(x)))
    shapes = F.when(F.col("vec_id") % 3 == 0, F.to_json(F.array(v))).when(F.col("vec_id") % 3 == 1, F.to_json(F.struct(F.array(v).alias("embeddings")))).otherwise(F.to_json(F.struct(F.array(F.struct(v.alias("embedding"))).alias("data"))))
    return S.vectors(e.select(F.col("vec_id").alias("feed"), shapes.alias("payload")))


@query("preference_default", "SELECT event_id AS feed, CASE WHEN event_id % 4 = 0 THEN 'prefer' ELSE 'default' END AS mode, CASE WHEN event_id % 4 = 0 THEN event_type ELSE '' END AS text FROM events")
def _(spark, sf):
    p = F.expr("case event_id % 4 when 0 then concat('{\"mode\": \"prefer\", \"text\": \"', event_type, ' \"}') when 1 then '{broken' when 2 then '{\"mode\": \"other\", \"text\": \"x\"}' else '[1]' end")
    return S.preference(table(spark, sf, "events").select(F.col("event_id").alias("feed"), p.alias("payload")))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def _feed_documents(spark, sf):
    """A feed of one document each, by doc_id % 8: RSS, RSS with content:encoded alone, Atom with two links, Atom with a summary; cut off, missing, without entries, and an item without a link before a good one."""
    d = table(spark, sf, "documents")
    xml = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, _CONTROL, ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    put = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text, title, link = xml("text"), put("<title>Item ", F.col("doc_id"), "</title>"), put("https://e.com/", F.col("doc_id"))
    date, author = "<pubDate>Mon, 1 Jan 2024 08:00:00 +0000</pubDate>", put("<dc:creator>", F.col("lang"), "</dc:creator>")
    rss = lambda *inner: put('<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>', *inner, "</channel></rss>")
    item = put("<item>", title, "<link>", link, "</link>", date, author)
    atom = put('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title><entry>', title, '<link rel="self" href="https://e.com/feed"/><link rel="alternate" href="', link, '"/><updated>2024-01-01T08:00:00Z</updated><author><name>', F.col("lang"), "</name></author>")
    kinds = [
        rss(item, "<description>", text, "</description><content:encoded>other</content:encoded></item>"),
        rss(item, "<description> </description><content:encoded>", text, "</content:encoded></item>"),
        put(atom, "<content>", text, "</content><summary>other</summary></entry></feed>"),
        put(atom, "<summary>", text, "</summary></entry></feed>"),
        put('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>', item),
        F.lit(None).cast("string"),
        rss(""),
        rss("<item><title>no link</title></item>", item, "<description>", text, "</description></item>"),
    ]
    payload = kinds[-1]
    for i, k in reversed(list(enumerate(kinds[:-1]))):
        payload = F.when(F.col("doc_id") % 8 == i, k).otherwise(payload)
    lost = F.when(F.col("source") != "src7", payload)
    return d.where("text is not null and lang is not null and doc_id is not null and source is not null").select("doc_id", F.col("source").alias("feed"), lost.alias("payload"))


_FEED_ROWS = r"""f AS (SELECT source, doc_id, doc_id % 8 AS kind, lang, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '<[^>]+>', ' ', 'g'), '[\s\p{Z}\x85]+', ' ', 'g')), 300) AS summary,
        CASE WHEN source = 'src7' OR doc_id % 8 = 5 THEN 'no payload' WHEN doc_id % 8 = 4 THEN 'no element found' WHEN doc_id % 8 = 6 THEN 'no entries' END AS error
    FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL AND source IS NOT NULL)"""


@query("feed_parse", f"WITH {_FEED_ROWS} SELECT source, doc_id, 'Item ' || doc_id AS title, 'https://e.com/' || doc_id AS url, lang AS author, '2024-01-01T08:00:00' AS published_at, summary FROM f WHERE error IS NULL")
def _(spark, sf):
    return S.feed_entries(_feed_documents(spark, sf)).where("error is null").select("source", "doc_id", "title", "url", "author", "published_at", "summary")


@query("feed_errors", f"WITH {_FEED_ROWS} SELECT source, doc_id, error FROM f WHERE error IS NOT NULL")
def _(spark, sf):
    found = S.feed_entries(_feed_documents(spark, sf)).where("error is not null")
    return found.select("source", "doc_id", F.substring_index("error", ":", 1).alias("error"))


@query("hot_list", "SELECT s_nationkey AS feed, 'https://z.com/' || url AS url, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY first) AS INTEGER) AS rank FROM (SELECT s_nationkey, s_suppkey % 7 AS url, min(s_suppkey) AS first FROM supplier GROUP BY ALL)")
def _(spark, sf):
    row = F.concat(F.lit('<a href="https://z.com/'), F.col("s_suppkey") % 7, F.lit('">t'), "s_suppkey", F.lit("</a><i>1,2"), F.col("s_suppkey") % 10, F.lit(" 万</i>"))
    pages = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("feed")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))).alias("rs"))
    pages = pages.select("feed", F.array_join(F.transform("rs", lambda x: x["r"]), "\n").alias("payload"))
    return S.hot_list(pages, r'<a href="([^"]+)">([^<]+)</a><i>([^<]*)</i>').select("feed", "url", "rank")


@query("serp_parse", "SELECT page_id AS feed, 'https://e.com/' || page_id AS url FROM pages")
def _(spark, sf):
    target = F.replace(F.replace(F.base64(F.concat(F.lit("https://e.com/"), "page_id").cast("binary")), F.lit("="), F.lit("")), F.lit("/"), F.lit("_"))
    page = F.concat(F.lit('<ol><li class="b_algo"><h2><a href="https://b.com/ck?x=1&amp;u=a1'), target, F.lit('">Title</a></h2><p>text</p></li></ol>'))
    return S.search_results(table(spark, sf, "pages").select(F.col("page_id").alias("feed"), page.alias("payload"))).select("feed", "url")


@query("trending_parse", "SELECT s_suppkey AS feed, r AS rank, 'o/r' || r AS full_name, 1200 AS stars FROM supplier, (SELECT unnest(generate_series(1, 6))::INTEGER AS r) WHERE s_suppkey % 3 > 0")
def _(spark, sf):
    row = lambda i: F.concat(F.lit('<article class="Box-row"><h2><a href="/o/r'), i, F.lit('">x</a></h2><p>d</p><a href="/o/r/stargazers">1.2k</a> 12 stars today</article>'))
    n = F.expr("case when s_suppkey % 3 > 0 then 6 else 4 end")
    page = F.array_join(F.transform(F.sequence(F.lit(1), n), row), "\n")
    return S.trending(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("feed"), page.alias("payload"))).select("feed", "rank", "full_name", "stars")


_KEPT = 20


def _union(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    names = d.union(spark.range(1).selectExpr("'nowhere' as source"))
    return S.union_stats(S.feed_entries(_feed_documents(spark, sf)), names, ["doc_id", "pos"], _KEPT)


@query("source_union_items", f"WITH {_FEED_ROWS} SELECT source, doc_id, summary FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM f WHERE error IS NULL) WHERE n <= {_KEPT}")
def _(spark, sf):
    return _union(spark, sf)[0].select("source", "doc_id", "summary")


@query("source_union_stats", f"""WITH {_FEED_ROWS}, n AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'nowhere'),
    s AS (SELECT source, count(*) FILTER (error IS NULL) AS good, count(error) AS failed, min_by(error, doc_id) FILTER (error IS NOT NULL) AS error FROM f GROUP BY 1)
    SELECT source, least(coalesce(good, 0), {_KEPT}) AS fetched, coalesce(failed, 0) AS failed, CASE WHEN coalesce(good, 0) = 0 THEN coalesce(s.error, 'unknown source') END AS error FROM n LEFT JOIN s USING (source)""")
def _(spark, sf):
    return _union(spark, sf)[1].withColumn("error", F.substring_index("error", ":", 1))


@query("source_fallback", sql("pool", "SELECT id, source FROM pool p WHERE points >= 400 OR (coalesce(points, 0) < 400 AND source NOT IN (SELECT source FROM pool WHERE points >= 400 AND source IS NOT NULL))"))
def _(spark, sf):
    """Of each source the rows that its primary service gave, else those of the other."""
    p = pool(spark, sf).select("id", "source", "points")
    return R.use_fallback(p.where("points >= 400"), p.where("coalesce(points, 0) < 400"), ["source"]).select("id", "source")


@query("incremental_sync", sql("replies", "SELECT reply_id, post_id, body, time FROM (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY time DESC) AS n FROM replies) WHERE n = 1"))
def _(spark, sf):
    """Four cycles of a poll: the first half, one in which the service is away, the first half again, then what has come since the mark."""
    r = replies(spark, sf).select("reply_id", "post_id", "body", "time")
    middle = r.agg((F.min(F.unix_seconds(F.col("time").cast("timestamp"))) / 2 + F.max(F.unix_seconds(F.col("time").cast("timestamp"))) / 2).alias("s"))
    first = r.join(F.broadcast(middle), F.unix_seconds(F.col("time").cast("timestamp")) <= F.col("s")).drop("s")
    index = Index(spark, place(spark, "index"), r.schema, "reply_id", newest="time", time="time")

    def away():
        raise ConnectionError("the service is away")

    cycles = iter([lambda: index.apply(first, 0), away, lambda: index.apply(first, 0), lambda: index.apply(index.since(r), 1)])
    J.watch(lambda: next(cycles)(), index.state, cycles=4, every=2, pause=0)
    return index.rows()


@query("private_purge", sql("posts", "SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT post_id FROM posts WHERE is_private)"))
def _(spark, sf):
    private = posts(spark, sf).where("is_private").select(F.col("post_id").alias("vec_id"))
    return J.purge(table(spark, sf, "embeddings").select("vec_id"), private, "vec_id")


@query("rate_limit_state", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) / 1e6 / 3600 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    r AS (SELECT client, ts, n, true AS accepted, [ts] AS recent FROM e WHERE n = 1
        UNION ALL SELECT client, ts, n, len(live) < 5, CASE WHEN len(live) < 5 THEN list_append(live, ts) ELSE live END
        FROM (SELECT e.client, e.ts, e.n, list_filter(r.recent, lambda x: e.ts - x <= 10.0) AS live FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1))
    SELECT client, ts, accepted FROM r""")
def _(spark, sf):
    """The clock runs 3,600 times as fast, so that limits are met."""
    e = table(spark, sf, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("ts")
    return J.limit_requests_batch(e.select(F.col("user_id").cast("string").alias("client"), seconds))
