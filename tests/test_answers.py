"""Answers of models against values worked out by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import answers as A


@pytest.mark.parametrize("text,limit,want", [(None, 9, ""), ("  ab  ", 9, "ab"), ("abcd, efgh ijkl", 12, "abcd"), ("ab, cdefghijklmnop", 12, "ab, cdefghij"), ("，，，，，，，，，，，，，", 9, "，" * 9)])
def test_clip(spark, text, limit, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.clip(F.col("t"), limit)).first()[0] == want


@pytest.mark.parametrize("titles,want", [(("标签：译名。。", "short", "主题"), "译名"), ((None, "short one", "主题"), "short one"), (("", "x" * 25, "主题"), "主题"), ((None, "x" * 25, None), ""), (("长" * 40, "a", "b"), "长" * 32 + "…")])
def test_post_headline(spark, titles, want):
    assert spark.createDataFrame([titles], "a string, b string, c string").select(X.post_headline(F.col("a"), F.col("b"), F.col("c"))).first()[0] == want


def test_picks_that_are_no_answers(spark):
    answers = [(1, None), (2, "no json"), (3, "[1]"), (4, '{"why": 3}'), (5, '{"title": null}'), (6, json.dumps({"title": " 'B' ", "why": "w" * 50, "post_titles": "x"}))]
    c = spark.createDataFrame([(6, 2, "b", None), (6, 1, "B ", None)], "day int, idx int, title string, summary string")
    found = {r.day: r for r in A.picks(spark.createDataFrame(answers, "day int, answer string"), c).collect()}
    assert [found[d].issue for d in range(1, 7)] == ["no_object"] * 3 + ["unbound_title"] * 2 + [None]
    assert found[6] == Row(day=6, issue=None, idx=1, why="w" * 50, digest="", post_titles=[])


def test_repo_descriptions(spark):
    said = {"trending_desc": {"a/b": "第一", "https://github.com/A/B/": "第二", "c/d": None, "x/y": "没有"}}
    answers = spark.createDataFrame([(1, json.dumps(said)), (2, "{}"), (3, None), (4, '{"trending_desc": [1]}')], "day int, answer string")
    trending = spark.createDataFrame([(1, "A/b"), (1, "c/d"), (2, "A/b")], "day int, title string")
    assert A.repo_descriptions(answers, trending).collect() == [Row(day=1, title="A/b", description="第二")]


def test_review_needs_all_parts(spark):
    news = spark.createDataFrame([(w, f"n{i}", f"u{i}", "2024-03-05") for w in range(1, 4) for i in range(6)], "week int, title string, url string, first_date string").withColumn("first_date", F.col("first_date").cast("date"))
    review = [{"title": f"n{i}", "text": "t", "category": "其 他"} for i in range(5)] + ["no object", {"title": "n9", "text": "t", "category": "其他"}]
    whole = {"review": review, "picks": [{"title": "n5", "reason": "r"}], "outlook": ["x"]}
    answers = spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(whole | {"review": review[1:]})), (3, json.dumps(whole | {"picks": []})), (4, None)], "week int, answer string")
    rows = A.review_sections(answers, news, news.where("false")).collect()
    assert {r.week for r in rows} == {1}
    assert sorted((r.kind, r.pos) for r in rows) == [("outlook", 1), ("pick", 1), *[("review", i) for i in range(1, 6)]]
    assert {r.text for r in rows} == {"预计 x", "r", "t（见 3/5 日报）"} and {r.category for r in rows if r.kind == "review"} == {"其他"}
    assert not A.review_sections(answers, news, news.where("title = 'n5'")).count()
