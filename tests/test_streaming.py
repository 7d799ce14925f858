"""Streams against the same work done at once: index, rate limit, cool-down."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plazalake.streaming import jobs
from plazalake.streaming.index import BUCKET, FAN, Index

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "id long, text string, at timestamp_ntz"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, START + dt.timedelta(minutes=m)) for i, t, m in rows], ROWS)


def test_index_keeps_the_first_or_the_newest(spark, tmp_path):
    batches = [[(1, "a", 0), (2, "a", 5), (2, "b", 4), (None, "x", 1)], [(2, "c", 3), (3, "c", 9)], [(1, "d", 7), (3, "e", 9)], []]
    first = Index(spark, f"file://{tmp_path}/first", ROWS)
    newest = Index(spark, f"file://{tmp_path}/newest", ROWS, newest="at", time="at")
    assert first.rows().count() == 0 and newest.mark() is None and newest.since(frame(spark, batches[0])).count() == 4
    for n, rows in enumerate(batches):
        for index in (first, newest):
            assert index.apply(frame(spark, rows), n) and not index.apply(frame(spark, rows), n)
    assert {r.id: r.text for r in first.rows().collect()} == {1: "a", 2: "a", 3: "c"}
    assert {r.id: r.text for r in newest.rows().collect()} == {1: "d", 2: "a", 3: "e"}
    assert newest.mark() == "2024-01-01 00:09:00" and newest.since(frame(spark, batches[1])).count() == 1


def test_index_reads_a_flat_number_of_runs(spark, tmp_path):
    random.seed(2)
    index = Index(spark, f"file://{tmp_path}/i", ROWS, newest="at", time="at")
    want, runs = {}, []
    for n in range(30):
        rows = [(random.randint(0, 40), f"{n}", n) for _ in range(5)]
        for i, t, _ in sorted(rows, key=lambda r: r[1]):
            want[i] = t
        index.apply(frame(spark, rows), n)
        runs.append(len(index.state()["runs"]))
    assert max(runs) < 2 * FAN and {r.id: r.text for r in index.rows().collect()} == want
    folders = [p.name for p in (tmp_path / "i").iterdir() if p.name.startswith("run-")]
    assert len(folders) <= 3 * FAN and len(list((tmp_path / "i" / "manifest").glob("[0-9]*"))) == 3


def test_index_reads_the_buckets_of_its_keys_alone(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", ROWS)
    index.apply(frame(spark, [(i, "a", i) for i in range(200)]), 0)
    found = index._read(index.state()["runs"], [3])
    assert {r[0] for r in found.select(BUCKET).distinct().collect()} == {3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_sync_that_is_taken_up_again(spark, tmp_path):
    put = lambda rows: frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "a", 0), (2, "a", 0), (2, "a", 0)])
    run = lambda: jobs.sync_stream(spark, str(tmp_path / "in"), ROWS, f"file://{tmp_path}/index", str(tmp_path / "cp")).awaitTermination(120)
    run()
    put([(2, "b", 1), (3, "b", 1)])
    run()
    run()
    index = Index(spark, f"file://{tmp_path}/index", ROWS)
    assert {r.id: r.text for r in index.rows().collect()} == {1: "a", 2: "a", 3: "b"}
    before = index.state()
    index._publish({**before, "batch": before["batch"] - 1})  # as if the last manifest was lost: its batch comes again
    assert index.state() == before
    put([(1, "c", 2), (4, "c", 2)])
    run()
    assert {r.id: r.text for r in index.rows().collect()} == {1: "a", 2: "a", 3: "b", 4: "c"}


def in_order(spark, path, batches, schema):
    """A stream that gives each batch in a micro-batch of its own."""
    for n, rows in enumerate(batches):
        out = str(path / f"b{n}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_rate_limit_of_a_stream(spark, tmp_path, rocks):
    random.seed(5)
    times = {c: sorted(round(random.uniform(0, 60), 3) for _ in range(n)) for c, n in (("a", 40), ("b", 12), ("hot", 300))}
    rows = [(c, at(t)) for c, ts in times.items() for t in ts]
    batches = [[r for r in rows if b * 20 <= (r[1] - at(0)).total_seconds() < (b + 1) * 20] for b in range(4)]
    for b in batches:
        random.shuffle(b)
    batches = [b for b in batches if b] + [[("end", at(4000))], [("end", at(9000))]]
    (tmp_path / "in").mkdir()
    stream = in_order(spark, tmp_path / "in", batches, "client string, at timestamp")
    q = jobs.limit_requests(stream, "1 second").writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(240)
    got = {}
    for r in spark.table("limited").where("client <> 'end'").collect():
        got.setdefault(r.client, []).append((round((r.at - at(0)).total_seconds(), 3), r.accepted))
    want = {c: list(zip(ts, jobs.admit(ts, [])[0], strict=True)) for c, ts in times.items()}
    assert {c: sorted(v) for c, v in got.items()} == {c: sorted(v) for c, v in want.items()}
    state = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "recent").load()
    assert {r.key.client for r in state.select("key").distinct().collect()} <= {"end"}  # quiet clients have none


def test_rate_limit_of_a_table(spark):
    random.seed(6)
    rows = [(f"c{i % 3}", random.uniform(0, 80)) for i in range(200)] + [("hot", i / 1000) for i in range(30_000)] + [(None, 1.0), ("c0", None)]
    got = {}
    for r in jobs.limit_requests_batch(spark.createDataFrame(rows, "client string, ts double")).collect():
        got.setdefault(r.client, []).append((r.ts, r.accepted))
    for c in ("c0", "c1", "c2", "hot"):
        ts = sorted(t for k, t in rows if k == c and t is not None)
        assert sorted(got[c]) == sorted(zip(ts, jobs.admit(ts, [])[0], strict=True))
    assert set(got) == {"c0", "c1", "c2", "hot"}


def test_sources_that_rest(spark, tmp_path, rocks):
    hour = 3600
    batches = [[("s", at(0), 403), ("t", at(0), 200)], [("s", at(5 * hour), 405), ("s", at(4 * hour), 403)], [("u", at(40 * hour), 403)], [("u", at(80 * hour), 200)], [("v", at(90 * hour), 403)]]
    (tmp_path / "in").mkdir()
    stream = in_order(spark, tmp_path / "in", batches, "source string, at timestamp, code int")
    q = jobs.cool_down(stream).writeStream.format("memory").queryName("resting").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(240)
    got = [(r.source, round((r.until - at(0)).total_seconds() / hour), r.resting) for r in spark.table("resting").collect()]
    assert sorted(got) == sorted([("s", 24, True), ("s", 29, True), ("s", 29, False), ("u", 64, True), ("u", 64, False), ("v", 114, True)])
