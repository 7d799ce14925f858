"""Rules, routes, health, guards, ladders and optional columns by definition; nearest vectors by force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import health as H
from plazalake.operators import knn
from plazalake.operators import relational as R
from plazalake.sources import tables

VECTORS = "vec_id long, label int, embedding array<float>"


def test_rules_by_force(spark, monkeypatch):
    random.seed(1)
    words = ["Disk", "full", "token", "磁盘", "fail", "a b", "x"]
    rules = [(f"r{i}", random.sample(words, random.randint(1, 3))) for i in range(25)] + [("none", []), ("null", None), ("odd", [None, "", "FULL"]), ("twice", ["full", "FULL", "disk"])]
    signals = [" ".join(random.choices(["disk", "FULL", "tokens", "磁盘满", "failed", "a", "b", "other"], k=random.randint(0, 5))) for _ in range(12)] + [None, ""]

    def fires(contains):
        need = [k.lower() for k in contains or [] if k]
        return any(all(k in s.lower() for k in need) for s in signals if s is not None)

    frame = spark.createDataFrame(rules, "rule string, contains array<string>")
    seen = spark.createDataFrame([(s,) for s in signals], "signal string")
    want = {r for r, c in rules if fires(c)}
    assert {r.rule for r in H.match_rules(frame, seen).collect()} == want
    monkeypatch.setattr(H, "KEYWORD_BYTES", 6)  # several automata
    assert {r.rule for r in H.match_rules(frame, seen).collect()} == want
    assert H.match_rules(frame, seen.limit(0)).count() == 0 and H.match_rules(frame.limit(0), seen).count() == 0


def test_advice_goes_to_the_first_section_or_the_first_that_is_not_ok(spark):
    advice = spark.createDataFrame([(1, "clean the Disk"), (2, "renew token on disk"), (3, "nothing known"), (4, None)], "id int, text string")
    routes = spark.createDataFrame([("digest", "token"), ("system", "disk"), ("gone", "nothing")], "section string, keyword string")
    sections = lambda *states: spark.createDataFrame([(s, i, x) for i, (s, x) in enumerate(zip(("assist", "digest", "system"), states, strict=True))], "section string, pos int, status string")
    got = {r.id: r.section for r in H.route_advice(advice, sections("ok", "ok", "warn"), routes).collect()}
    assert got == {1: "system", 2: "digest", 3: "system", 4: "system"}
    assert {r.section for r in H.route_advice(advice, sections("ok", "ok", "ok"), routes).where("id > 2").collect()} == {"assist"}
    assert {r.section for r in H.route_advice(advice, sections("ok", "ok", "ok").limit(0), routes).collect()} == {None}


def test_health_ladder(spark):
    now = "2024-01-10 12:00:00"
    day = lambda n, h=12: dt.datetime(2024, 1, 10, h) + dt.timedelta(days=n)
    hosts = spark.createDataFrame([(h,) for h in "abcdefgh"], "host string")
    disks = spark.createDataFrame([("a", 50), ("b", 90), ("c", 99), ("d", None), ("e", 90), ("f", 10)], "host string, pct int")
    certs = spark.createDataFrame([("a", "/etc/live/x.com/cert.pem", day(40)), ("a", "/etc/live/y.com/cert.pem", day(30)), ("d", "one.pem", day(30)), ("e", "/l/z/c", day(3)), ("f", "/l/q/c", day(14, 11)), ("c", "/l/q/c", day(-1)), ("h", "/l/q/c", None)], "host string, path string, ends timestamp_ntz")
    timers = spark.createDataFrame([("f", "t2", "active"), ("g", "t2", "failed"), ("g", "t1", None), ("g", "t3", "active")], "host string, unit string, state string")
    bands = spark.createDataFrame([("disk", None, 84.0, "ok"), ("disk", 85.0, 94.0, "warn"), ("disk", 95.0, None, "critical"), ("certificate", None, 14.0, "warn"), ("certificate", 15.0, None, "ok")], "metric string, low double, high double, status string")
    got = {r.host: r for r in H.host_health(hosts, disks, certs, timers, bands, now).collect()}
    assert {h: r.status for h, r in got.items()} == {"a": "ok", "b": "warn", "c": "critical", "d": "ok", "e": "warn", "f": "warn", "g": "critical", "h": "unknown"}
    assert (got["a"].domain, got["a"].days_left) == ("y.com", 30) and got["d"].domain == "one.pem" and got["f"].days_left == 13 and got["c"].days_left == -1
    assert got["g"].dead == ["t1", "t2"] and got["g"].notes == ["no_disk", "no_certificate", "dead_timers"] and got["e"].notes == ["disk_warn", "certificate_ends"]


def test_title_ladder(spark):
    recent = ["一个完全相同的标题在这里"]
    cases = [
        (["", None, "2026-09-12 新的标题"], "x", "新的标题"),
        (["一个完全相同的标题在这里", "另外一句话"], "x", "另外一句话"),
        (["9/12 一个完全相同的标题在这里"], "保底", "保底"),
        (["一个完全相同的标题在这里"], "x", "一个完全相同的标题在这里"),
        (["2026-09-12 " + "长" * 25, "盘点今天"], "《保底》", "保底"),
        (["3、带序号的"], "x", "带序号的"),
        ([], None, ""),
        (None, "a", "a"),
    ]
    rows = spark.createDataFrame([(i, c, recent, f) for i, (c, f, _) in enumerate(cases)], "i int, c array<string>, r array<string>, f string")
    got = [r[0] for r in rows.orderBy("i").select(X.title_ladder(F.col("c"), F.col("r"), F.col("f"))).collect()]
    assert got == [w for *_, w in cases]


def test_title_ladder_between_ideographic_spaces(spark):
    rows = spark.createDataFrame([(["\u3000" + "长" * 30],)], "c array<string>")
    assert rows.select(X.title_ladder(F.col("c"), F.array().cast("array<string>"), F.lit("x"))).first()[0] == "长" * 30


def test_saved_answers_list_five_references(spark):
    refs = "[" + ",".join(f'{{"title": "t{i}", "url": "u{i}", "more": 1}}' for i in range(7)) + "]"
    rows = spark.createDataFrame([(1, " ", refs), (2, "yes", "[broken"), (3, "yes", None), (4, "yes", '{"a": 1}'), (5, "yes", '[{"title": "only"}]')], "id int, answer string, references_json string")
    got = {r.id: r for r in R.saved_answers(rows).collect()}
    assert got[1].answer is None and got[1].used == 7 and got[1].listed.split("\n")[4] == "  [5] t4 → u4" and len(got[1].listed.split("\n")) == 5
    assert [got[i].used for i in (2, 3, 4, 5)] == [0, 0, 0, 1] and got[5].listed == "  [1] only → " and got[2].listed == ""


def test_guards(spark):
    texts = {"SELECT 1": "read", "\n select x": "read", "with a as (select 1) select 2": "rejected", "insert into ASSIST_RESPONSES": "write", "drop table posts": "rejected", "": "rejected", None: "rejected"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", tables.statement_kind(F.col("t"))).collect()} == texts
    assert tables.read_only(spark, " select 1 as x").collect()[0].x == 1
    with pytest.raises(PermissionError):
        tables.read_only(spark, "drop table posts")


def test_columns_that_may_be_absent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = "id long, a string, b double"
    assert tables.parquet_or_empty(spark, path, schema).count() == 0
    (tmp_path / "t").mkdir()
    assert tables.parquet_or_empty(spark, path, schema).count() == 0
    spark.createDataFrame([(1, "x", 2.0, 5)], "id long, a string, b double, more int").write.mode("append").parquet(path)
    spark.createDataFrame([(2,)], "id long").write.mode("append").parquet(path)
    assert sorted(map(tuple, tables.parquet_or_empty(spark, path, schema).collect())) == [(1, "x", 2.0), (2, None, None)]


def test_fallback_of_a_key(spark):
    pool = spark.createDataFrame([("a", 1)], "source string, id int")
    live = spark.createDataFrame([("a", 2), ("b", 3)], "source string, id int")
    assert sorted(r.id for r in R.use_fallback(pool, live, ["source"]).collect()) == [1, 3]
    assert sorted(r.id for r in R.use_fallback(pool.limit(0), live).collect()) == [2, 3] and [r.id for r in R.use_fallback(pool, live).collect()] == [1]


def nearest_by_force(rows, queries, k, threshold):
    known = [(i, np.array(v, float)) for i, _, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for q, v in queries:
        if v is None or not any(v):
            continue
        v = np.array(v, float)
        scored = sorted(((-round(float((x / np.sqrt(x @ x)) @ (v / np.sqrt(v @ v))), 12), i) for i, x in known))
        out |= {(q, i, n + 1) for n, (s, i) in enumerate(scored[:k]) if -s >= threshold}
    return out


@pytest.mark.parametrize("spread", [0.05, 2.0])
def test_nearest_by_pivots_is_exact(spark, monkeypatch, spread):
    for name, value in (("PER_PIVOT", 40), ("SHELL", 15), ("POINTS", 12), ("QUERIES", 9), ("PIVOTS", (4, 1024))):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 10))
    rows = [(i, i % 3, [float(x) for x in centres[i % 12] + spread * rng.standard_normal(10)]) for i in range(700)]
    rows += [(1000 + i, 9, rows[5][2]) for i in range(60)] + [(2000, 1, None), (2001, 1, [0.0] * 10), (2002, 1, [float("nan")] * 10)]
    points = spark.createDataFrame(rows, VECTORS)
    queries = [(i, v) for i, _, v in rows if i % 20 == 0]
    asked = spark.createDataFrame([(i, v) for i, v in queries], "query_id long, q array<float>")
    hits, visits = knn.nearest_by_pivots(points, asked, 7, 0.2)
    as_floats = [(i, n, None if v is None else [float(np.float32(x)) for x in v]) for i, n, v in rows]
    want = nearest_by_force(as_floats, [(i, v) for i, _, v in as_floats if i % 20 == 0], 7, 0.2)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in hits.collect()} == want
    met = visits.agg(F.sum("pairs")).first()[0] / (len(rows) - 3) / (len(queries) - 1)
    assert met <= 1 and (spread > 1 or met < 0.5)  # of separate groups most blocks are skipped
    none = knn.nearest_by_pivots(points.limit(0), asked, 7, 0.2)
    assert none[0].count() == 0
