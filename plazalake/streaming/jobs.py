"""Structured Streaming jobs: incremental index sync, purge, rate limit."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from time import sleep

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plazalake.streaming.index import Index

log = logging.getLogger(__name__)
LIMIT, SPAN_SECONDS = 5, 10.0
ACCEPTED = "client string, ts double, accepted boolean"


def incremental(rows: DataFrame, known: DataFrame, mark, time: str = "time", key: str = "id") -> DataFrame:
    """Rows from the high-water mark on (the mark itself too) that aren't known."""
    since = rows if mark is None else rows.where(F.col(time) >= F.lit(mark))
    return since.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def purge(points: DataFrame, private: DataFrame, key: str) -> DataFrame:
    return points.join(private.select(key).distinct(), key, "left_anti")


def first_marks(known: DataFrame, sources: dict[str, DataFrame], time: str = "time") -> DataFrame:
    """source, mark: marks that are known stay, so that a full sync taken up again keeps those it began with;
    the others are the newest time of their source now, or 1970 where it is empty. Taken before anything is scanned."""
    newest = [rows.agg(F.max(time).cast("timestamp_ntz").alias("_new")).select(F.lit(name).alias("source"), "_new") for name, rows in sources.items()]
    marks = newest[0]
    for more in newest[1:]:
        marks = marks.union(more)
    kept = known.select("source", F.col("mark").alias("_old"))
    return marks.join(kept, "source", "left").select("source", F.coalesce("_old", "_new", F.expr("timestamp_ntz '1970-01-01 00:00:00'")).alias("mark"))


def watch(sync: Callable[[], None], clean: Callable[[], None], cycles: int | None = None, every: int = 20, pause: float = 30.0) -> list[tuple[int, str]]:
    """Call sync again and again, clean after every `every`th of them; a cycle that fails is told and the next one goes on.

    sync starts an availableNow stream and awaits it: what a failed batch had is in its checkpoint, so the next cycle takes it up.
    """
    failed, cycle = [], 0
    while cycles is None or cycle < cycles:
        cycle += 1
        for step in [sync, clean] if every and cycle % every == 0 else [sync]:
            try:
                step()
            except Exception as error:  # noqa: BLE001  any failure belongs to its cycle alone
                log.warning("cycle %d: %r", cycle, error)
                failed = [*failed[-99:], (cycle, repr(error))]
                break
        if cycle != cycles:
            sleep(pause)
    return failed


def sync_stream(spark: SparkSession, source: str, schema, index_path: str, checkpoint: str, key: str = "id", newest: str | None = None, time: str | None = None):
    """Keep an index up to date with files that arrive in source; a batch that is repeated after a failure changes nothing."""
    stream = spark.readStream.schema(schema).parquet(source)

    def upsert(batch: DataFrame, number: int) -> None:
        Index(batch.sparkSession, index_path, schema, key, newest, time).apply(batch, number)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit(times: list[float], recent: list[float], limit: int = LIMIT, span: float = SPAN_SECONDS) -> tuple[list[bool], list[float]]:
    """Which requests at these times, in order, are accepted, given recent accepted ones; only those count."""
    recent, out = list(recent), []
    for t in times:
        while recent and t - recent[0] > span:
            recent.pop(0)
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


class _Limit(StatefulProcessor):
    """Requests wait in a map by time until the watermark has passed them; a timer for each time takes them in order.

    The list holds the accepted times of the last span. A timer after that empties it, so
    a client that is quiet has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "times array<long>")
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        for row in rows:
            at = row["_at"]
            ms = -(-at // 1000)
            known = list(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), ([*known, at],))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        times = sorted(self.waiting.getValue((now,))[0]) if self.waiting.containsKey((now,)) else []
        recent = sorted(r[0] for r in self.recent.get()) if self.recent.exists() else []
        span = int(SPAN_SECONDS * 1_000_000)
        if times:
            self.waiting.removeKey((now,))
            accepted, recent = admit(times, recent, LIMIT, span)
        else:
            accepted = []
            recent = [t for t in recent if now * 1000 - t <= span]
        if recent:
            self.recent.put([(t,) for t in recent])
            self.handle.registerTimer(-(-(recent[-1] + span) // 1000) + 1)
        else:
            self.recent.clear()
        for t, ok in zip(times, accepted, strict=True):
            yield Row(client=key[0], at=t, accepted=ok)

    def close(self) -> None:
        pass


def limit_requests(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(client, at timestamp) with accepted, in the order of at: LIMIT requests in SPAN_SECONDS, of which only accepted ones count.

    A request is decided when nothing older than it by `delay` can come any more; later
    ones are lost, as late rows are. Needs the RocksDB state store.
    """
    rows = stream.withWatermark("at", delay).select("client", "at", F.unix_micros("at").alias("_at"))
    found = rows.groupBy("client").transformWithState(_Limit(), "client string, at long, accepted boolean", "append", "eventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


class _Cool(StatefulProcessor):
    """Until when a source rests; its timer ends that."""

    def __init__(self, hours: float):
        self.ms = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        last = max(row["_ms"] for row in rows) + self.ms
        held = self.until.get()[0] if self.until.exists() else None
        if held is None or last > held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.until.update((last,))
            self.handle.registerTimer(last)
            yield Row(source=key[0], until=last, resting=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        last = self.until.get()[0]
        self.until.clear()
        yield Row(source=key[0], until=last, resting=False)

    def close(self) -> None:
        pass


def cool_down(stream: DataFrame, hours: float = 24, codes: tuple[int, ...] = (403, 405), delay: str = "1 minute") -> DataFrame:
    """source, until, resting of (source, at, code): a row when a refused source begins to rest or rests for longer, and one when its rest ends."""
    refused = stream.where(F.col("code").isin(*codes)).withWatermark("at", delay).select("source", "at", F.unix_millis("at").alias("_ms"))
    found = refused.groupBy("source").transformWithState(_Cool(hours), "source string, until long, resting boolean", "append", "eventTime")
    return found.withColumn("until", F.timestamp_millis("until"))


def limit_requests_batch(rows: DataFrame) -> DataFrame:
    """The same over a table (client, ts in seconds): each task goes through its clients in order, sorted by Spark, and holds one client's accepted times."""

    def run(batches):
        held, recent = None, []
        for batch in batches:
            clients, times, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for client, t in zip(clients, times, strict=True):
                if client != held:
                    held, recent = client, []
                ok, recent = admit([t], recent)
                out += ok
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["client", "ts", "accepted"])

    known = rows.where("client is not null and ts is not null")
    return known.select("client", F.col("ts").cast("double").alias("ts")).repartition("client").sortWithinPartitions("client", "ts").mapInArrow(run, ACCEPTED)
