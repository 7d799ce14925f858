"""Recorded payloads of feeds and services as item rows.

An item: title, url, source, author, published_at, summary, points, rank. JSON goes
through variants, so a payload that isn't JSON gives no rows; XML and HTML go through
small parsers in Arrow batches.
"""

from __future__ import annotations

import base64
import re
import xml.etree.ElementTree as ET
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalake.functions.text import local_iso, parse_num
from plazalake.sources.payloads import parse_payloads
from plazalake.sources.shared import cut

ITEM = ["title", "url", "source", "author", "published_at", "summary", "points", "rank"]
LEAST_POINTS, MOST_HITS, MOST_ARTICLES, LEAST_ROWS = 20, 15, 20, 5


def _entries(payload: DataFrame, path: str, column: str = "payload") -> DataFrame:
    """The payload's other columns, pos and entry: elements of the array at path."""
    parsed = payload.withColumn("_a", F.try_variant_get(F.try_parse_json(column), path, "array<variant>"))
    keep = [c for c in payload.columns if c != column]
    return parsed.select(*keep, F.posexplode("_a").alias("pos", "entry"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("entry", path, kind)


def _items(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Rows with ITEM columns; null where not given. Items without title or URL go."""
    out = {c: columns.get(c, F.lit(None)) for c in ITEM} | {"source": F.lit(source)}
    kinds = {"points": "long", "rank": "int"}
    keep = [c for c in rows.columns if c != "entry"]
    found = rows.select(*keep, *[F.trim(out[c]).alias(c) if c in ("title", "url") else out[c].cast(kinds.get(c, "string")).alias(c) for c in ITEM])
    return found.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def first_of(rows: DataFrame, most: int, by: str = "feed") -> DataFrame:
    """The first `most` items of each payload."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("_n") <= most).drop("_n")


def news_hits(payloads: DataFrame) -> DataFrame:
    """(feed, payload) of a search service: linked stories of LEAST_POINTS and more, the first MOST_HITS."""
    rows = _entries(payloads, "$.hits")
    found = _items(rows, "hacker-news", title=_get("$.title"), url=_get("$.url"), author=_get("$.author"), published_at=local_iso(_get("$.created_at")), points=_get("$.points", "long"))
    return first_of(found.where(F.col("points") >= LEAST_POINTS), MOST_HITS)


def story_items(payloads: DataFrame) -> DataFrame:
    """(feed, payload) of single stories of the fallback service: neither deleted nor dead."""
    rows = payloads.select("feed", F.lit(0).alias("pos"), F.try_parse_json("payload").alias("entry"))
    rows = rows.where((_get("$.type") == "story") & ~F.coalesce(_get("$.deleted", "boolean"), F.lit(False)) & ~F.coalesce(_get("$.dead", "boolean"), F.lit(False)))
    when = F.date_format(F.timestamp_seconds(_get("$.time", "long")), "yyyy-MM-dd'T'HH:mm:ss")
    found = _items(rows, "hacker-news", title=_get("$.title"), url=_get("$.url"), author=_get("$.by"), published_at=when, points=_get("$.score", "long"))
    return found.where(F.col("points") >= LEAST_POINTS)


def articles(payloads: DataFrame) -> DataFrame:
    """(feed, payload): a JSON array of articles with reactions."""
    rows = _entries(payloads, "$")
    return _items(rows, "devto", title=_get("$.title"), url=_get("$.url"), author=_get("$.user.name"), published_at=local_iso(_get("$.published_at")), summary=_get("$.description"), points=_get("$.positive_reactions_count", "long"))


def ranked_articles(payloads: DataFrame) -> DataFrame:
    """(feed, payload) with nested article_info, if its err_no is 0; points: hot_index, else view_count."""
    good = payloads.where(F.try_variant_get(F.try_parse_json("payload"), "$.err_no", "int") == 0)
    info = "$.item_info.article_info."
    number = _get(info + "article_id")
    points = F.coalesce(F.nullif(_get(info + "hot_index", "long"), F.lit(0)), _get(info + "view_count", "long"), F.lit(0))
    url = F.when(F.trim(number) != "", F.concat(F.lit("https://juejin.cn/post/"), F.trim(number)))
    return first_of(_items(_entries(good, "$.data"), "juejin", title=_get(info + "title"), url=url, summary=F.trim(_get(info + "brief_content")), points=points), MOST_ARTICLES)


def flow_articles(payloads: DataFrame) -> DataFrame:
    """(feed, payload) of mixed resources: articles that are neither paid nor priced."""
    rows = _entries(payloads, "$.data.items").where(
        (_get("$.resource_type") == "article") & ~F.coalesce(_get("$.resource.is_paid", "boolean"), F.lit(False)) & (F.coalesce(_get("$.resource.price", "double"), F.lit(0.0)) == 0)
    )
    when = F.date_format(F.timestamp_seconds(_get("$.resource.display_time", "long")), "yyyy-MM-dd'T'HH:mm:ss")
    return _items(rows, "wallstreetcn", title=_get("$.resource.title"), url=_get("$.resource.uri"), published_at=when, summary=_get("$.resource.content_short"))


def repositories(payloads: DataFrame, seen: DataFrame) -> DataFrame:
    """(feed, payload) of a repository search: rank in it; known names go, of repeats the first stays."""
    rows = _entries(payloads, "$.items").select("feed", (F.col("pos") + 1).alias("rank"), _get("$.full_name").alias("full_name"), _get("$.html_url").alias("url"), _get("$.language").alias("language"), F.coalesce(_get("$.stargazers_count", "long"), F.lit(0)).alias("stars"), F.coalesce(F.nullif(_get("$.description"), F.lit("")), F.lit("(无描述)")).alias("desc"))
    rows = rows.where("full_name <> ''").join(seen.select("full_name"), "full_name", "left_anti")
    place = F.row_number().over(Window.partitionBy("feed", "full_name").orderBy("rank"))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n").withColumn("url", F.coalesce("url", F.concat(F.lit("https://github.com/"), "full_name")))


#: A negative zero as JSON writes it; read as a decimal it would lose its sign, with an exponent it doesn't.
NEGATIVE_ZERO = r"(?<=[\[,\s])-0(?:\.0+)?(?=[\],\s])"


def vectors(payloads: DataFrame) -> DataFrame:
    """feed, pos, vector of any known shape of an embedding response."""
    v = F.try_parse_json(F.regexp_replace("payload", NEGATIVE_ZERO, "-0e0"))
    read = lambda path: F.try_variant_get(v, path, "array<array<double>>")
    nested = F.transform(F.try_variant_get(v, "$.data", "array<variant>"), lambda x: F.try_variant_get(x, "$.embedding", "array<double>"))
    found = F.coalesce(read("$"), read("$.embeddings"), read("$.vectors"), nested, read("$.result"))
    return payloads.select("feed", F.posexplode(found).alias("pos", "vector"))


def preference(rows: DataFrame, most: int = 500) -> DataFrame:
    """feed, mode, text: the default for anything that isn't valid."""
    v = F.try_parse_json("payload")
    mode = F.coalesce(F.nullif(F.try_variant_get(v, "$.mode", "string"), F.lit("")), F.lit("default"))
    text = F.trim(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & mode.isin("default", "prefer") & ((mode != "prefer") | (text != "")) & (F.char_length(text) <= most)
    return rows.select("feed", F.when(ok, mode).otherwise("default").alias("mode"), F.when(ok, text).otherwise("").alias("text"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


#: Fields of an entry as read_entries gives them.
ENTRY = "title string, url string, author string, published string, summary string"
#: Characters of a summary.
SUMMARY = 300


def _plain(markup: str) -> str:
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", markup)).split())[:SUMMARY]


def read_entries(xml: str) -> list[tuple]:
    """ENTRY of the RSS items and Atom entries that have a title and a link; fails if it isn't XML."""
    out = []
    for el in ET.fromstring(xml).iter():
        kind = _local(el.tag)
        if kind not in ("item", "entry"):
            continue
        found: dict[str, list] = {}
        for child in el:
            found.setdefault(_local(child.tag), []).append(child)
        value = lambda *names: next((t for n in names for c in found.get(n, ()) if (t := (c.text or "").strip())), "")  # noqa: B023, E731
        if kind == "item":
            link, author, text = value("link"), value("creator"), value("description", "encoded")
        else:
            link = next((c.get("href").strip() for c in found.get("link", ()) if c.get("rel") in (None, "alternate") and c.get("href")), "")
            author = next((t.text or "" for c in found.get("author", ()) for t in c if _local(t.tag) == "name"), "").strip()
            text = value("content", "summary")
        title = value("title")
        if title and link:
            out.append((title, link, author, value("pubDate", "published", "updated"), _plain(text)))
    return out


def feed_entries(payloads: DataFrame) -> DataFrame:
    """(feed, payload, ...) of RSS and Atom documents as items with error: one row with it for a payload that is missing, broken or empty."""
    rows = parse_payloads(payloads, read_entries, ENTRY)
    return rows.withColumns({"source": F.col("feed"), "published_at": local_iso(F.col("published"))}).drop("published")


def feed_items(payloads: DataFrame) -> DataFrame:
    """The items alone, with the columns that all sources have; feed is the source's name."""
    rows = feed_entries(payloads).where("error is null")
    return rows.select("feed", "pos", "title", "url", "source", "author", "published_at", "summary", F.lit(None).cast("long").alias("points"), F.lit(None).cast("int").alias("rank"))


def union_stats(rows: DataFrame, names: DataFrame, order: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Items and stats of several sources, each failing for itself.

    rows (source, error, ...) are items and failures as feed_entries gives them; names
    (source) are the sources that were asked for. Of each source the first `most` items in
    this order are kept. stats: source, fetched, failed (payloads), error (the first in this
    order; null where something was fetched, "unknown source" where nothing is known of it).
    Reading the stats fails if no source gave anything. Rows are made once, as a table.
    """
    rows = cut(rows, "feed-rows")
    place = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    items = rows.where("error is null").withColumn("_n", place).where(F.col("_n") <= most).drop("_n", "error")
    bad = rows.where("error is not null").groupBy("source").agg(F.count(F.lit(1)).alias("failed"), F.min_by("error", F.struct(*order)).alias("_error"))
    good = items.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"))
    counts = names.select("source").distinct().join(good, "source", "left").join(bad, "source", "left")
    fetched, failed = F.coalesce("fetched", F.lit(0)), F.coalesce("failed", F.lit(0))
    error = F.when(fetched == 0, F.coalesce("_error", F.lit("unknown source")))
    known = counts.select("source", fetched.alias("fetched"), failed.alias("failed"), error.alias("error"))
    whole = known.agg(F.sum("fetched").alias("_all"), F.min_by("error", "source").alias("_first"))
    checked = F.when(F.col("_all") == 0, F.raise_error(F.concat(F.lit("all sources failed; the first: "), "_first"))).otherwise(F.col("fetched"))
    stats = known.join(F.broadcast(whole), F.lit(True)).select("source", checked.alias("fetched"), "failed", "error")
    return items, stats


def capped(items: DataFrame, caps: DataFrame) -> DataFrame:
    """Items within the cap of their source (source, cap); sources without one go."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("pos"))
    return items.join(caps, "source").withColumn("_n", place).where("_n <= cap").drop("_n", "cap")


def filtered(items: DataFrame, pattern: str, most: int | None = None, order: tuple[str, ...] = ("pos",)) -> tuple[DataFrame, DataFrame]:
    """Items whose title doesn't match, the first `most` of each feed, and by feed how many do.

    As a reader stops when it has enough, those that match after the last item kept don't count.
    """
    hit = F.coalesce(F.col("title").rlike(pattern), F.lit(False))
    kept, left = items.where(~hit), items.where(hit)
    feeds = items.select("feed").distinct()
    if most is not None:
        place = F.row_number().over(Window.partitionBy("feed").orderBy(*order))
        kept = kept.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
        end = kept.groupBy("feed").agg(F.max(F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == most)
        left = left.join(end.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left").drop("_feed").where(F.col("_last").isNull() | (F.struct(*order) < F.col("_last")))
    counts = left.groupBy("feed").agg(F.count(F.lit(1)).alias("skipped"))
    found = feeds.join(counts.withColumnRenamed("feed", "_feed"), F.col("feed").eqNullSafe(F.col("_feed")), "left")
    return kept, found.select("feed", F.coalesce("skipped", F.lit(0)).alias("skipped"))


_ROW = re.compile(r"(?s)<article[^>]*Box-row[^>]*>(.*?)</article>")


def read_trending(html: str | None) -> list[tuple]:
    """(rank, full_name, language, stars, today, desc) of a trending page; none below LEAST_ROWS."""
    text = lambda x: " ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split())
    pick = lambda p, x: next((text(m) for m in re.findall(p, x)), "")
    rows = []
    for part in _ROW.findall(html or ""):
        name = re.search(r'(?s)<h2[^>]*>.*?href="/([^"/]+/[^"/]+)"', part)
        if name:
            rows.append((len(rows) + 1, name[1], pick(r'(?s)itemprop="programmingLanguage"[^>]*>(.*?)<', part), pick(r'(?s)href="[^"]*/stargazers"[^>]*>(.*?)</a>', part), pick(r"([\d,.km]+)\s+stars today", part), pick(r"(?s)<p[^>]*>(.*?)</p>", part)))
    return rows if len(rows) >= LEAST_ROWS else []


TRENDING = "rank int, full_name string, language string, stars string, today string, desc string"


def trending(payloads: DataFrame) -> DataFrame:
    """feed, rank, full_name, language, stars, today_stars, desc; pages that aren't such lists give nothing."""
    rows = parse_payloads(payloads, read_trending, TRENDING).where("error is null")
    return rows.select("feed", "rank", "full_name", F.nullif("language", F.lit("")).alias("language"), parse_num(F.col("stars")).alias("stars"), parse_num(F.col("today")).alias("today_stars"), F.coalesce(F.nullif("desc", F.lit("")), F.lit("(无描述)")).alias("desc"))


def hot_list(payloads: DataFrame, pattern: str) -> DataFrame:
    """feed, rank, url, title, heat by a pattern of three groups; the first of each URL, ranked by what is kept."""
    group = lambda i: F.regexp_extract_all("payload", F.lit(pattern), F.lit(i))
    rows = payloads.select("feed", F.posexplode(F.arrays_zip(group(1).alias("url"), group(2).alias("title"), group(3).alias("heat"))).alias("pos", "e"))
    rows = rows.select("feed", "pos", "e.url", F.trim("e.title").alias("title"), F.coalesce(F.regexp_extract(F.replace("e.heat", F.lit(","), F.lit("")), r"^\s*(\d+)", 1).try_cast("long"), F.lit(0)).alias("heat")).where("title <> ''")
    first = F.row_number().over(Window.partitionBy("feed", "url").orderBy("pos"))
    rows = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("feed").orderBy("pos"))).drop("pos")


@F.pandas_udf(T.StringType())
def redirect_target(urls: pd.Series) -> pd.Series:
    """The address in the u parameter of a search engine's redirect, in URL-safe base64 after two characters."""

    def target(url):
        found = re.search(r"[?&]u=a1([\w-]+)", url or "")
        if not found:
            return url
        try:
            return base64.urlsafe_b64decode(found[1] + "=" * (-len(found[1]) % 4)).decode()
        except ValueError:
            return url

    return urls.map(target)


def search_results(payloads: DataFrame) -> DataFrame:
    """feed, pos, url, title, snippet of a result page."""
    part = F.regexp_extract_all("payload", F.lit(r'(?s)<li class="b_algo"[^>]*>(.*?)</li>'), F.lit(1))
    rows = payloads.select("feed", F.posexplode(part).alias("pos", "x"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    link = r'(?s)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    found = rows.select("feed", "pos", redirect_target(F.replace(F.regexp_extract("x", link, 1), F.lit("&amp;"), F.lit("&"))).alias("url"), plain(F.regexp_extract("x", link, 2)).alias("title"), plain(F.regexp_extract("x", r"(?s)<p[^>]*>(.*?)</p>", 1)).alias("snippet"))
    return found.where("url <> '' and title <> ''")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    frames = list(parts.values())
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
