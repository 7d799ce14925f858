"""Fuzzy de-duplication against the same choices made one item after the other."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plazalake.operators import dedup as D

SCHEMA = "id long, url string, title string"


def same(a, b):
    return bool(a[1] and a[1] == b[1]) or bool(a[2] and b[2] and SequenceMatcher(None, a[2].lower(), b[2].lower()).ratio() >= 0.85)


def greedy(items, history=()):
    kept, out = [], {}
    for it in items:
        hit = next((h[0] for h in history if same(it, h)), None)
        hit = next((k[0] for k in kept if same(it, k)), None) if hit is None else hit
        if hit is None:
            kept.append(it)
        out[it[0]] = hit
    return out


def some_items(seed, n, urls):
    random.seed(seed)
    words = "alpha beta gamma delta release of new engine for data lake version".split()
    base = [" ".join(random.choices(words, k=5)) for _ in range(9)]

    def near():
        t = list(random.choice(base))
        for _ in range(random.randint(0, 7)):
            t[random.randrange(len(t))] = random.choice("abcxyz ")
        return "".join(t)

    return [(i, random.choice([None, "", *[f"https://e.com/{random.randint(0, urls)}"] * 8]), random.choice([None, "", *[near()] * 12])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ord", F.col("id"))


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_by_force(spark, monkeypatch, seed):
    items = some_items(seed, 110, 45)
    history = [(i, f"https://h.com/{i}" if i % 3 else f"https://e.com/{i}", t) for i, _, t in some_items(seed + 50, 6, 5)]
    for rounds in (1, 6):  # with one round, most is decided over pairs
        monkeypatch.setattr(D, "GROUP_ROUNDS", rounds)
        got = D.greedy_dedup(frame(spark, items)).collect()
        assert {r.id: r.dup_of for r in got} == greedy(items) and all(r.kept == (r.dup_of is None) for r in got)
    got = D.greedy_dedup(frame(spark, items), frame(spark, history)).collect()
    assert {r.id: r.dup_of for r in got} == greedy(items, history) and all(r.kept == (r.dup_of is None) for r in got)


def chosen(spark, rows):
    reps = rows.select("id", F.struct(F.col("ord"), F.col("id")).alias("o"), "u", "t")
    near = reps.where("t <> ''").select("t").distinct().selectExpr("t as new", "t as old")
    return D._choose(reps, near)


def test_a_chain_in_order(spark):
    n = 4000
    chain = spark.range(n).selectExpr("id", "id as ord", "concat('u', id div 2) as u", "concat('t', (id + 1) div 2) as t")
    got = chosen(spark, chain)
    assert got.count() == n // 2 and not got.where("id % 2 = 1").take(1)


def test_stars_and_cliques(spark):
    clique = spark.range(20_000).selectExpr("id", "id as ord", "'same' as u", "concat('t', id) as t")
    assert [r.id for r in chosen(spark, clique).collect()] == [0]
    # the middle comes last and shares the URL of one and the title of all others
    star = spark.range(2000).selectExpr("id", "id as ord", "concat('u', id) as u", "'t' as t")
    assert [r.id for r in chosen(spark, star).collect()] == [0]
    last = spark.range(2001).selectExpr("id", "id as ord", "if(id = 2000, 'u7', concat('u', id)) as u", "if(id = 2000, 'm', concat('t', id)) as t")
    assert chosen(spark, last).where("id = 2000").count() == 0


def test_a_short_rest_takes_no_more_rounds(spark, monkeypatch):
    made, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df, name: made.append(name) or cut(df, name))
    chain = spark.range(40).selectExpr("id", "id as ord", "concat('u', id div 2) as u", "concat('t', (id + 1) div 2) as t")
    assert sorted(r.id for r in chosen(spark, chain).collect()) == list(range(0, 40, 2)) and len(made) <= 3
    # only URLs are shared: no pairs of titles are left
    only = spark.range(3).selectExpr("id", "id as ord", "'u' as u", "'' as t")
    assert [r.id for r in D._in_turn(only.selectExpr("id", "struct(ord, id) as o", "u", "t"), spark.createDataFrame([], "new string, old string")).collect()] == [0]


def test_a_long_rest_takes_rounds_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "LAST", 0)
    items = some_items(3, 110, 45)
    for rounds in (1, 6):
        monkeypatch.setattr(D, "GROUP_ROUNDS", rounds)
        assert {r.id: r.dup_of for r in D.greedy_dedup(frame(spark, items)).collect()} == greedy(items)


def test_pairs_that_depend_on_each_other(spark):
    random.seed(9)
    n = 300
    pairs = {(r, p) for r in range(n) for p in random.sample(range(r), min(r, random.randint(0, 3)))}
    state = {}
    for r in range(n):
        state[r] = not any(state[p] for q, p in pairs if q == r)
    left = spark.range(n)
    got = D._settle(left, spark.createDataFrame(sorted(pairs), "r long, p long")).collect()
    assert {r.id: r.kept for r in got} == state and len(got) == n


def test_links_by_force(spark):
    items = some_items(4, 90, 30)
    got = {r.id: r for r in D.fuzzy_links(frame(spark, items)).collect()}
    assert len(got) == len(items)
    for a in items:
        assert got[a[0]].links == sum(same(a, b) for b in items if b[0] != a[0])
        assert got[a[0]].class_id == (min(b[0] for b in items if (b[1] or "", (b[2] or "").lower()) == (a[1] or "", (a[2] or "").lower())) if a[1] or a[2] else a[0])
    first = {}
    for i, _, t in items:
        first.setdefault((t or "").lower(), i)
    first.pop("")
    want = {(first[a], first[b]) for a in first for b in first if a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert {(r.a, r.b) for r in D.title_links(frame(spark, items)).collect()} == want


def test_merged_news_by_force(spark):
    items = [(*it, f"2024-05-{1 + it[0] // 20:02}", random.choice([None, "", f"s{random.randint(0, 3)}"])) for it in some_items(6, 90, 40)]
    merged: list = []
    for it in items:
        hit = next((m for m in merged if same(it, m["item"])), None)
        text = it[4] or ""
        if hit is None:
            merged.append({"item": it, "days": 1, "day": it[3], "texts": [text]})
        else:
            hit["days"] += 1
            if text and text not in hit["texts"]:
                hit["texts"].append(text)
    merged.sort(key=lambda m: (-m["days"], m["day"]))
    rows = spark.createDataFrame(items, SCHEMA + ", day string, summary string").withColumn("ord", F.col("id"))
    got = D.merge_news(rows).collect()
    assert [(r.id, r.title, r.url, r.days, r.first_day, r.summaries) for r in got] == [(m["item"][0], m["item"][2], m["item"][1], m["days"], m["day"], m["texts"]) for m in merged]


def read(spark, rows, schema):
    """A frame of rows and a count of those that were read from it."""
    n = spark.sparkContext.accumulator(0)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda r: n.add(1) or r), schema), n


def test_items_are_read_once(spark):
    rows = [(i, i, u, t, "2024-05-01", "s") for i, u, t in some_items(7, 30, 9)]
    items, n = read(spark, rows, "id long, ord long, url string, title string, day string, summary string")
    assert sum(r.days for r in D.merge_news(items).collect()) == 30 and n.value == 30


def test_what_an_upsert_reads_is_read_once(spark):
    rows = [(i, i, u, t) for i, u, t in some_items(8, 30, 9)]
    schema = "id long, ord long, url string, title string"
    (items, n), (pool, m) = read(spark, rows, schema), read(spark, rows[:9], schema)
    got = D.pool_upsert(items, pool.withColumn("first_seen", F.expr("timestamp_ntz '2024-05-01 00:00:00'")), items.limit(0), "2024-04-01 00:00:00").collect()
    assert len(got) == sum(bool(u and t) for _, _, u, t in rows) and (n.value, m.value) == (30, 9)


def test_nothing(spark):
    none = frame(spark, [(1, "u", "t")]).limit(0)
    assert D.greedy_dedup(none).count() == 0 and D.fuzzy_links(none).count() == 0 and D.title_links(none).count() == 0
    assert [tuple(r) for r in D.greedy_dedup(frame(spark, [(1, None, None), (2, None, None)])).orderBy("id").collect()] == [(1, True, None), (2, True, None)]


def test_pairs_carry_numbers_of_titles(spark):
    a = spark.createDataFrame([(1, "one title here"), (2, ""), (3, "one title her")], "id long, t string")
    b = spark.createDataFrame([(4, "one title here"), (5, "other")], "id long, t string")
    *rows, near = D._numbered(a, b)
    found = {r.id: r.t for side in rows for r in side.collect()}
    assert found[1] == found[4] and found[2] == 0 and len(set(found.values())) == 4
    like = {(found[1], found[3]), (found[3], found[1])}
    assert {tuple(r) for r in near.collect()} == like | {(n, n) for n in found.values() if n}
