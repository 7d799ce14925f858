"""Probes, service logs and the remaining gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import gates as G
from plazalake.plans.roles import run_log, sql
from plazalake.sources import logs as L
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("service_errors", sql("run_log", "SELECT id, 'job ' || id || ' ERROR' AS line FROM run_log WHERE id % 4 = 1"))
def _(spark, sf):
    line = F.expr("case id % 4 when 0 then '== log ==' when 1 then concat(' job ', id, ' ERROR ') when 2 then 'INFO: ERROR count 0' else 'fine' end")
    return L.service_errors(run_log(spark, sf).select("id", line.alias("line")), "line")


@query("disk_report", "SELECT s_suppkey, '216G' AS size, '165G' AS used, CAST(s_suppkey % 100 AS INTEGER) AS percent FROM supplier WHERE s_suppkey % 5 > 0")
def _(spark, sf):
    report = F.concat(F.lit("Filesystem Size Used Avail Use% Mounted\n\n/dev/vda1  216G 165G 51G "), F.expr("case when s_suppkey % 5 = 0 then 'x' else cast(s_suppkey % 100 as string) end"), F.lit("% /\n"))
    return L.disk_rows(table(spark, sf, "supplier").select("s_suppkey", report.alias("value"))).drop("value")


@query("certificate_days", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) END AS days FROM orders")
def _(spark, sf):
    line = F.expr("case when o_orderkey % 6 = 0 then 'unable to load certificate' else concat('notAfter=', date_format(o_orderdate, 'MMM d HH:mm:ss yyyy'), ' GMT') end")
    return table(spark, sf, "orders").select("o_orderkey", F.datediff(F.to_date(L.certificate_end(line)), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("rag_hits", "SELECT o_custkey AS query_id, o_orderkey AS post_id, round(1.0::DOUBLE / rank, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 5 AND o_orderkey % 3 > 0")
def _(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    source = F.expr("case when o_orderkey % 3 > 0 then concat('market_', o_orderkey, '.txt') else 'faq_1.txt' end")
    return L.rag_hits(table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), source.alias("source")), 9)


@query("glossary", "SELECT conv_id, turn, CASE WHEN length(text) >= 10 AND turn % 2 = 0 THEN 'term ' || turn END AS term FROM conversations")
def _(spark, sf):
    item = F.array(F.struct(F.concat(F.lit(" term "), "turn").alias("term"), F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("é"))).otherwise("short").alias("expl")))
    answer = F.when(F.char_length("text") >= 10, F.to_json(F.struct(item.alias("glossary")))).otherwise("no json")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.get(G.glossary(answer, "éa-z"), F.lit(0))["term"].alias("term"))


@query("candidate_qualified", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag IN ('A', 'N') AND l_linestatus = 'O' AND l_quantity / 5 >= 7 AND l_discount >= 0.02 AS qualified FROM lineitem")
def _(spark, sf):
    purpose = F.when(F.col("l_linestatus") == "O", "knowledge").otherwise("promotion")
    q = G.qualified(F.col("l_returnflag"), purpose, ["A", "N"], F.col("l_quantity") / 5, F.col("l_discount") >= 0.02)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q.alias("qualified"))


@query("body_issues", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN t <> regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') THEN 'publication_body_not_normalized' END, CASE WHEN length(t) > 5000 THEN 'publication_body_too_long' END], lambda x: x IS NOT NULL), ',') AS issues FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END AS t FROM documents WHERE trim(text) <> '')")
def _(spark, sf):
    d = table(spark, sf, "documents").where("trim(text) <> ''")
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return d.select("doc_id", F.array_join(G.body_issues(t, 5000), ",").alias("issues"))


@query("source_date", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS day FROM events")
def _(spark, sf):
    raw = F.expr("case event_id % 3 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") end")
    return table(spark, sf, "events").select("event_id", X.source_date(raw).alias("day"))


@query("report_window", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END, TIMESTAMP '1998-06-01' - INTERVAL 2 DAY) AS since FROM orders")
def _(spark, sf):
    last = F.expr("case when o_orderkey % 4 > 0 then date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') else 'never' end")
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(last.try_cast("timestamp_ntz"), F.expr("timestamp_ntz '1998-06-01' - interval 2 days")).alias("since"))
