"""Codes of drafts and packets, lossless title pairs, the pool's upsert, and the watch loop."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plazalake.operators import dedup as D
from plazalake.operators import drafts
from plazalake.operators.lifecycle import write_allowed
from plazalake.plans import registry
from plazalake.streaming.jobs import watch

SF = "/root/testdata/sf0.001"


def _variants(seed):
    r = random.Random(seed)
    out = set()
    for _ in range(40):
        base = "".join(r.choice("abcd e") for _ in range(r.randint(1, 24)))
        out.add(base)
        for _ in range(5):
            x = list(base)
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(x) + 1)
                if r.random() < 0.5:
                    x.insert(k, r.choice("abcdé"))
                elif x:
                    x.pop(k - 1)
            out.add("".join(x))
    return sorted(t for t in out if t)


@pytest.mark.parametrize("seed", [5, 6])
def test_similar_titles_loses_no_pair(spark, seed):
    titles = _variants(seed)
    want = {(a, b) for a in titles for b in titles if SequenceMatcher(None, a, b).ratio() >= D.THRESHOLD}
    found = D.similar_titles(spark.createDataFrame([(t,) for t in titles], "t string")).collect()
    assert {(r.new, r.old) for r in found} == want and len(found) == len(want)


def test_pool_upsert_follows_the_order_of_the_batch(spark):
    schema = "id long, ord long, url string, title string"
    pool = spark.createDataFrame([(1, 1, "https://a.com/1", "An old title of the pool", "2023-01-01"), (2, 2, "https://a.com/2", "A recent title of the pool", "2024-01-30")], schema + ", day string")
    pool = pool.withColumn("first_seen", F.to_timestamp_ntz("day")).drop("day")
    history = spark.createDataFrame([(1, 1, "https://h.com/1", "Something that was printed")], schema)
    items = spark.createDataFrame(
        [
            (1, 1, "https://a.com/1?utm_source=x", "Another title"),  # known URL, of any age
            (2, 2, "https://b.com/2", "A recent title of the pools"),  # as a recent row
            (3, 3, "https://b.com/3", "An old title of the pool"),  # as a row out of the window
            (4, 4, "https://b.com/4", "Something that was printed!"),  # as history
            (5, 5, "https://b.com/5", "Entirely new words here"),
            (6, 6, "https://b.com/6", "Entirely new words here."),  # as an item inserted before
            (7, 7, "https://b.com/5#x", "Other words for that page"),  # the URL of an item inserted before
            (8, 8, "", "No address"),
            (9, 9, "https://b.com/9", " "),
        ],
        schema,
    )
    got = {r.id: r.action for r in D.pool_upsert(items, pool, history, "2024-01-16 00:00:00").collect()}
    assert got == {1: "refresh", 2: "drop", 3: "insert", 4: "drop", 5: "insert", 6: "drop", 7: "refresh"}


def test_every_code_of_the_drafts_occurs(spark):
    found = {c for (codes,) in registry.queries()["draft_issues"](spark, SF).select("issues").collect() for c in codes.split(",")}
    assert {
        "empty_content", "source_hash_mismatch", "invalid_source_url", "invalid_evidence_kind", "truncated", "invalid_publication_status", "missing_source_blocks",
        "invalid_source_block", "unbound_source_block", "duplicate_source_block", "invalid_schema_version", "excluded_article_type", "missing_title", "draft_source_mismatch",
        "missing_research_checks", "missing_evidence", "unbound_evidence_quote", "missing_sections", "invalid_section", "unclosed_code_fence", "unsupported_markup",
        "invalid_test_status", "missing_test_record", "empty_markdown", "editorial_placeholder",
    } <= found | {""}


def test_absent_packets_and_drafts(spark):
    row = spark.range(1).select(F.lit(None).cast(drafts.PACKET).alias("packet"), F.lit(None).cast(drafts.DRAFT).alias("draft"))
    assert drafts.draft_issues(row).first().issues == ["missing_source"]
    empty = spark.range(1).select(F.from_json(F.lit("{}"), drafts.PACKET).alias("packet"), F.lit(None).cast(drafts.DRAFT).alias("draft"))
    assert drafts.draft_issues(empty).first().issues == ["empty_content", "invalid_source_url", "invalid_evidence_kind", "missing_source_blocks", "missing_draft"]


def test_public_urls(spark):
    urls = {"https://a.com/x?y=1#z": True, "http://a.com:80": True, "HTTPS://a.com": True, "https://u@a.com/": False, "ftp://a.com": False, "https:///x": False, "https://a.com/\tx": False, "": False}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", drafts.public_url(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == urls


def test_watch_survives_a_failing_cycle_and_cleans_every_twentieth():
    calls, cleaned = [], []

    def sync():
        calls.append(1)
        if len(calls) in (3, 40):
            raise RuntimeError("down")

    failed = watch(sync, lambda: cleaned.append(len(calls)), cycles=60, every=20, pause=0)
    assert len(calls) == 60 and [c for c, _ in failed] == [3, 40] and cleaned == [20, 60]


def test_only_listed_tables_are_written():
    assert write_allowed("assist_responses") == "assist_responses"
    with pytest.raises(ValueError, match="posts"):
        write_allowed("posts")
