"""Feeds that fail for themselves, as tables of payloads and as a data source."""

from __future__ import annotations

import json

import pytest

from plazalake.sources import feeds
from plazalake.sources.feed_source import FeedSource
from plazalake.sources.payloads import parse_payloads

RSS = """<rss xmlns:c="http://purl.org/rss/1.0/modules/content/" xmlns:d="http://purl.org/dc/elements/1.1/"><channel>
<item><title> First </title><link>http://e.com/1</link><description>&lt;p&gt;Hello &amp;amp; hi&lt;/p&gt;</description><c:encoded>whole</c:encoded><d:creator>Ann</d:creator><pubDate>Tue, 16 Sep 2025 08:00:00 +0200</pubDate></item>
<item><title>no link</title><description>x</description></item>
<item><title>Second</title><link>http://e.com/2</link><description> </description><c:encoded>body</c:encoded></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>A</title><link rel="self" href="s"/><link href="http://a.com"/><updated>2024-05-01T00:00:00Z</updated><author><name>N</name></author><summary>s</summary></entry>
<entry><title>only self</title><link rel="self" href="s"/></entry></feed>"""
PAYLOADS = [("rss", 1, RSS), ("atom", 1, ATOM), ("broken", 1, "<rss><channel>"), ("lost", 1, None), ("bare", 1, "<rss><channel/></rss>"), ("rss", 2, "no xml at all"), ("rss", 3, "")]


def payloads(spark, rows=PAYLOADS):
    return spark.createDataFrame(rows, "feed string, ord int, payload string")


def test_entries_of_both_kinds(spark):
    got = {(r.feed, r.pos): r for r in feeds.feed_entries(payloads(spark)).where("error is null").collect()}
    assert set(got) == {("rss", 0), ("rss", 1), ("atom", 0)}
    first = got["rss", 0]
    assert (first.title, first.url, first.author, first.published_at, first.summary) == ("First", "http://e.com/1", "Ann", "2025-09-16T06:00:00", "Hello & hi")
    assert got["rss", 1].summary == "body" and got["rss", 1].published_at is None
    assert (got["atom", 0].url, got["atom", 0].author, got["atom", 0].summary) == ("http://a.com", "N", "s")


def test_a_failing_payload_leaves_the_others_alone(spark):
    errors = {(r.feed, r.ord): r.error for r in feeds.feed_entries(payloads(spark)).where("error is not null").collect()}
    assert set(errors) == {("broken", 1), ("lost", 1), ("bare", 1), ("rss", 2), ("rss", 3)}
    assert errors["lost", 1] == "no payload" and errors["bare", 1] == "no entries" and errors["broken", 1].startswith("no element found")
    assert feeds.feed_items(payloads(spark)).count() == 3


def test_stats_name_every_source(spark):
    names = spark.createDataFrame([(n,) for n in ("rss", "atom", "broken", "lost", "nowhere", "rss")], "source string")
    items, stats = feeds.union_stats(feeds.feed_entries(payloads(spark)), names, ["ord", "pos"], 1)
    assert sorted((r.source, r.title) for r in items.collect()) == [("atom", "A"), ("rss", "First")]
    got = {r.source: (r.fetched, r.failed, r.error) for r in stats.collect()}
    assert got["rss"] == (1, 2, None) and got["atom"] == (1, 0, None)
    assert got["lost"] == (0, 1, "no payload") and got["nowhere"] == (0, 0, "unknown source")


def test_all_sources_failing_is_an_error(spark):
    names = spark.createDataFrame([("broken",), ("lost",)], "source string")
    stats = feeds.union_stats(feeds.feed_entries(payloads(spark, PAYLOADS[2:4])), names, ["ord", "pos"], 5)[1]
    with pytest.raises(Exception, match="all sources failed"):
        stats.collect()


def test_payloads_of_any_size_and_names(spark):
    long = "<rss><channel><item><title>t</title><link>u</link><description>" + "word " * 400_000 + "</description></item></channel></rss>"
    rows = spark.createDataFrame([(i, "old", "x", long if i % 2 else RSS) for i in range(12)], "pos int, error string, title string, payload string")
    got = parse_payloads(rows.withColumnRenamed("pos", "id"), feeds.read_entries, feeds.ENTRY).collect()
    assert len(got) == 6 + 6 * 2 and all(r.error is None for r in got) and {r.title for r in got} == {"t", "First", "Second"}
    assert parse_payloads(rows.limit(0), feeds.read_entries, feeds.ENTRY).count() == 0


def test_filter_stops_counting_when_full(spark):
    titles = ["a", "License", None, "b", "c license", "d", "license"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(titles)] + [("g", 0, "license"), (None, 0, "license"), (None, 1, "x")], "feed string, pos int, title string")
    kept, counts = feeds.filtered(rows, "(?i)license", 3)
    assert sorted((r.feed or "", r.pos) for r in kept.collect()) == [("", 1), ("f", 0), ("f", 2), ("f", 3)]
    assert {r.feed: r.skipped for r in counts.collect()} == {"f": 1, "g": 1, None: 1}
    assert {r.feed: r.skipped for r in feeds.filtered(rows, "(?i)license")[1].collect()} == {"f": 3, "g": 1, None: 1}


def test_trending_page(spark):
    row = '<article class="Box-row"><h2><a href="/o/r{0}">x</a></h2><p>d {0}</p><span itemprop="programmingLanguage">Go</span><a href="/o/r/stargazers">1.2k</a> 12 stars today</article>'
    rows = payloads(spark, [("page", 1, "".join(row.format(i) for i in range(6))), ("short", 1, row), ("lost", 1, None)])
    got = sorted(tuple(r) for r in feeds.trending(rows).collect())
    assert len(got) == 6 and got[0] == ("page", 1, "o/r0", "Go", 1200, 12, "d 0")


def test_feeds_as_a_data_source(spark, tmp_path):
    for name, text in (("rss", RSS), ("atom", ATOM), ("broken", "<rss>"), ("_hidden", RSS)):
        (tmp_path / f"{name}.xml").write_text(text)
    spark.dataSource.register(FeedSource)
    found = spark.read.format("feeds").option("path", str(tmp_path)).load()
    assert found.rdd.getNumPartitions() == 3
    got = sorted((r.feed, r.pos if r.pos is not None else -1, r.title) for r in found.collect())
    assert got == [("atom", 0, "A"), ("broken", -1, None), ("rss", 0, "First"), ("rss", 1, "Second")]
    places = {"rss": f"file://{tmp_path}/rss.xml", "gone": f"file://{tmp_path}/none.xml"}
    rows = spark.read.format("feeds").option("feeds", json.dumps(places)).load()
    assert {r.feed: r.n for r in rows.where("error is not null").groupBy("feed").count().withColumnRenamed("count", "n").collect()} == {"gone": 1}
    names = spark.createDataFrame([("rss",), ("gone",)], "source string")
    stats = feeds.union_stats(rows.withColumnRenamed("feed", "source"), names, ["pos"], 20)[1]
    assert {r.source: r.fetched for r in stats.collect()} == {"rss": 2, "gone": 0}


def test_vectors_keep_the_sign_of_zero(spark):
    import math

    from pyspark.sql import functions as F

    from plazalake.plans import registry
    from plazalake.sources import feeds

    rows = spark.createDataFrame([(1, "[[-0.0, -0, 0.0, -0.5, 10.0]]"), (2, '{"data": [{"embedding": [1.0, -0.00]}]}')], "feed long, payload string")
    got = {r.feed: [math.copysign(1, x) for x in r.vector] for r in feeds.vectors(rows).collect()}
    assert got == {1: [-1, -1, 1, -1, 1], 2: [1, -1]}
    sf = "/root/testdata/sf0.1"
    tiny = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.expr("size(filter(embedding, x -> x < 0 and x > -0.000005f))").alias("n")).where("n > 0")
    want = {r.vec_id: r.n for r in tiny.collect()}
    found = registry.queries()["embedding_shapes"](spark, sf).where(F.col("feed").isin(list(want))).collect()
    assert want and {r.feed: sum(x == 0 and math.copysign(1, x) < 0 for x in r.vector) for r in found} == want
