"""Rules over signals, advice by section, health of hosts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalake.operators.reports import worst
from plazalake.sources.shared import cut

#: Bytes of keywords that one automaton holds; more go through in several passes.
KEYWORD_BYTES = 8 << 20
#: Rows of bands that may be broadcast.
BANDS = 10_000

_held: dict = {}


def _automaton(token: str, words: list[str]):
    """The automaton of a block of keywords, kept in a worker for its next tasks."""
    if token not in _held:
        found = ahocorasick.Automaton()
        for w in words:
            found.add_word(w, w)
        found.make_automaton()
        _held.clear()
        _held[token] = found
    return _held[token]


def _blocks(keywords: DataFrame) -> Iterator[list[str]]:
    block, held = [], 0
    for r in keywords.toLocalIterator():
        block.append(r[0])
        held += len(r[0].encode())
        if held >= KEYWORD_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def keyword_hits(texts: DataFrame, keywords: DataFrame, text_col: str = "text", out_col: str = "hits") -> DataFrame:
    """texts with out_col: the keywords (one column, in lower case) that the lower-case text contains, sorted; none in a null text.

    All keywords of a block are looked for at once, in one pass over the texts, in Arrow batches.
    """
    context = texts.sparkSession.sparkContext
    kept = texts.drop(out_col).withColumn("_low", F.lower(text_col)).withColumn(out_col, F.array().cast("array<string>"))
    at = kept.columns.index("_low")
    words = keywords.select(F.col(keywords.columns[0]).alias("w")).where("w <> ''").distinct()
    for block in _blocks(words):
        shared, token = context.broadcast(block), uuid.uuid4().hex

        def run(batches, shared=shared, token=token):
            automaton = _automaton(token, shared.value)
            for batch in batches:
                out = [sorted({w for _, w in automaton.iter(t)} | set(h)) if t else h for t, h in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, batch.schema.field(at + 1).type)], schema=batch.schema)

        kept = kept.mapInArrow(run, T.StructType(kept.schema.fields))
    return kept.drop("_low")


def match_rules(rules: DataFrame, signals: DataFrame) -> DataFrame:
    """rule: those of rules (rule, contains) of which one of signals (signal) contains all keywords, whatever the case.

    An inverted index leads from keyword to rules. A signal meets the rules whose rarest
    keyword it holds, and no others; those fire if it holds the rest too. Null and empty
    keywords ask for nothing; a rule without keywords fires if there is any signal.
    """
    asked = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("contains", F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != ""), lambda k: F.lower(k))))
    own = rules.select("rule", asked.alias("need")).distinct()
    words = own.select(F.explode("need").alias("word"))
    known = signals.where("signal is not null").select("signal")
    hits = keyword_hits(known, words, "signal").select("hits").where("size(hits) > 0").distinct()
    sets = cut(hits.withColumn("id", F.monotonically_increasing_id()), "hits")
    each = sets.select("id", F.explode("hits").alias("word"))
    seen = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    posted = own.select("rule", "need", F.explode("need").alias("word")).join(seen, "word").groupBy("rule", "need").agg(F.count(F.lit(1)).alias("found"), F.min_by("word", F.struct("n", "word")).alias("word"))
    posted = posted.where(F.col("found") == F.size("need")).select("rule", "need", "word")
    met = each.join(posted, "word").select("id", "rule", "need")
    fired = met.join(sets, "id").where(F.size(F.array_except("need", "hits")) == 0).select("rule")
    any_signal = known.limit(1).select(F.lit(1).alias("_one"))
    bare = own.where("size(need) = 0").join(F.broadcast(any_signal), F.lit(True), "left_semi").select("rule")
    return fired.union(bare).distinct()


def route_advice(advice: DataFrame, sections: DataFrame, routes: DataFrame) -> DataFrame:
    """advice (id, text) with section: the first of sections (section, pos, status) of which the text holds a keyword of routes (section, keyword).

    Else the first that isn't ok, else the first of all; null without sections.
    """
    places = routes.select("section", F.lower("keyword").alias("word")).where("word <> ''").join(sections.select("section", "pos"), "section")
    first = places.groupBy("word").agg(F.min("pos").alias("pos"))
    hits = keyword_hits(advice.select("id", "text"), first.select("word")).select("id", F.explode("hits").alias("word"))
    found = hits.join(first, "word").groupBy("id").agg(F.min("pos").alias("pos"))
    rest = sections.agg(F.coalesce(F.min(F.when(F.col("status") != "ok", F.col("pos"))), F.min("pos")).alias("_rest"))
    placed = advice.select("id").distinct().join(found, "id", "left").join(F.broadcast(rest), F.lit(True)).select("id", F.coalesce("pos", "_rest").alias("pos"))
    return placed.join(sections.select("pos", "section"), "pos", "left").select("id", "section")


def earliest_certificate(certificates: DataFrame, now: str) -> DataFrame:
    """host, domain, days_left of certificates (host, path, ends): that of each host which ends first, of a tie the first path.

    domain is the folder that the file lies in; days are whole ones, rounded down. Without an end a file doesn't count.
    """
    best = certificates.where("ends is not null").groupBy("host").agg(F.min(F.struct("ends", "path")).alias("c"))
    parts = F.split(F.regexp_replace("c.path", "/+$", ""), "/")
    seconds = F.unix_seconds(F.col("c.ends").cast("timestamp")) - F.unix_seconds(F.lit(now).cast("timestamp"))
    return best.select("host", F.when(F.contains("c.path", F.lit("/")), F.element_at(parts, -2)).otherwise(F.col("c.path")).alias("domain"), F.floor(seconds / 86400).alias("days_left"))


def in_bands(values: DataFrame, bands: DataFrame) -> DataFrame:
    """values (host, metric, value) joined with the bands (metric, low, high, status) that they lie in, both ends included, null ends open."""
    fits = (F.coalesce(F.col("value") >= F.col("low"), F.col("low").isNull())) & (F.coalesce(F.col("value") <= F.col("high"), F.col("high").isNull()))
    small = bands.limit(BANDS + 1).count() <= BANDS
    side = bands.withColumnRenamed("metric", "_metric")
    return values.join(F.broadcast(side) if small else side, (F.col("metric") == F.col("_metric")) & fits).drop("_metric")


def host_health(hosts: DataFrame, disks: DataFrame, certificates: DataFrame, timers: DataFrame, bands: DataFrame, now: str) -> DataFrame:
    """host, status, pct, domain, days_left, dead (timers that aren't active, sorted), notes of hosts (host).

    disks (host, pct), certificates (host, path, ends), timers (host, unit, state); bands give
    the status of metrics disk and certificate. A host with neither is unknown; one with a
    dead timer is critical, whatever else; a certificate alone never makes more than a warning.
    """
    disk = disks.where("pct is not null").groupBy("host").agg(F.max("pct").alias("pct"))
    cert = earliest_certificate(certificates, now)
    dead = timers.where("coalesce(state, '') <> 'active'").groupBy("host").agg(F.sort_array(F.collect_set("unit")).alias("dead"))
    values = disk.select("host", F.lit("disk").alias("metric"), F.col("pct").cast("double").alias("value")).union(cert.select("host", F.lit("certificate"), F.col("days_left").cast("double")))
    rated = in_bands(values, bands).groupBy("host").agg(
        worst("status").alias("rated"), F.max(F.when(F.col("metric") == "disk", F.concat(F.lit("disk_"), F.col("status")))).alias("disk_note"), F.bool_or((F.col("metric") == "certificate") & (F.col("status") != "ok")).alias("soon")
    )
    rows = hosts.select("host").distinct().join(disk, "host", "left").join(cert, "host", "left").join(dead, "host", "left").join(rated, "host", "left")
    has_dead = F.coalesce(F.size("dead") > 0, F.lit(False))
    status = F.when(has_dead, "critical").when(F.col("pct").isNull() & F.col("days_left").isNull(), "unknown").otherwise(F.coalesce("rated", F.lit("ok")))
    notes = F.array_compact(
        F.array(
            F.when(F.col("pct").isNull(), "no_disk"),
            F.when(F.col("days_left").isNull(), "no_certificate"),
            F.when(F.col("disk_note") != "disk_ok", F.col("disk_note")),
            F.when(F.col("soon"), "certificate_ends"),
            F.when(has_dead, "dead_timers"),
        )
    )
    return rows.select("host", status.alias("status"), "pct", "domain", "days_left", F.coalesce("dead", F.array().cast("array<string>")).alias("dead"), notes.alias("notes"))
