"""Phase 6: reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import gates as G
from plazalake.operators import health as H
from plazalake.operators import reports as R
from plazalake.plans.roles import pool, posts, run_log, sql
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


_KIND = """CASE WHEN status = 'ok' AND tag = 'published' THEN 'published' WHEN status = 'ok' AND tag = 'dry_run_token_ok' THEN 'dry_run'
    WHEN status = 'skipped' AND tag IN ('weekend', 'not_saturday', 'publish_dup') THEN 'expected_skip' WHEN status = 'degraded' THEN 'degraded' ELSE 'failed' END"""


@query("outcome_kind", sql("run_log", f"SELECT id, {_KIND} AS kind FROM run_log"))
def _(spark, sf):
    return run_log(spark, sf).select("id", R.outcome_kind().alias("kind"))


_CODES = "(['200', '502', '421', '404', '499'])[CAST(id % 5 + 1 AS INTEGER)]"


def _access(spark, sf):
    path = F.expr("case when id % 7 = 0 then '/other' else '/api/v1/assist/match' end")
    code = F.expr("element_at(array('200', '502', '421', '404', '499'), cast(id % 5 + 1 as int))")
    return run_log(spark, sf).select(F.concat(F.lit('1.2.3.4 - - "POST '), path, F.lit(' HTTP/1.1" '), code, F.lit(" 12")).alias("value"))


@query("status_histogram", sql("run_log", f"SELECT CAST({_CODES} AS INTEGER) AS status, count(*) AS n FROM run_log WHERE id % 7 <> 0 GROUP BY 1"))
def _(spark, sf):
    return R.access_lines(_access(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("assist_health", sql("run_log", f"""SELECT count(*) AS total, count(*) FILTER (s BETWEEN 200 AND 299) AS ok, count(*) FILTER (s >= 500) AS server_errors,
    round(100.0::DOUBLE * count(*) FILTER (s BETWEEN 200 AND 299) / count(*), 2) AS rate FROM (SELECT CAST({_CODES} AS INTEGER) AS s FROM run_log WHERE id % 7 <> 0)"""))
def _(spark, sf):
    return R.status_summary(R.access_lines(_access(spark, sf)))


@query("nginx_errors", sql("run_log", """SELECT CASE id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:0') || substring(strftime(ts, '%S'), 1, 1) ELSE '2024-02-01T00:00:00' END AS ts, id
    FROM run_log WHERE status = 'degraded'"""))
def _(spark, sf):
    at = F.expr("case id % 3 when 0 then date_format(ts, 'yyyy/MM/dd HH:mm:ss') when 1 then date_format(ts, 'dd/MMM/yyyy:HH:mm:ss') else 'no time' end")
    tag = F.expr("case when status = 'degraded' then '[error]' else '[warn]' end")
    lines = run_log(spark, sf).select(F.concat(at, F.lit(" "), tag, F.lit(" upstream prematurely closed /api/v1/assist/match #"), "id").alias("value"))
    return R.nginx_errors(lines, "2024-02-01 00:00:00").select("ts", F.regexp_extract("text", r"#(\d+)", 1).cast("long").alias("id"))


def _log_lines(spark, sf):
    level = F.expr("element_at(array('INFO', 'WARNING', 'ERROR'), cast(id % 3 + 1 as int))")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 "), level, F.lit(" task "), "task", F.lit(" failed for user "), "user_id")
    return run_log(spark, sf).select("id", line.alias("value"))


@query("log_errors", sql("run_log", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, (['INFO', 'WARNING', 'ERROR'])[CAST(id % 3 + 1 AS INTEGER)] AS level, 'task ' || task || ' failed for user ' || user_id AS text FROM run_log WHERE id % 3 > 0 AND ts >= TIMESTAMP '2024-01-10'"))
def _(spark, sf):
    return R.log_errors(_log_lines(spark, sf), "2024-01-10 00:00:00")


@query("error_cluster", sql("run_log", """SELECT 'task ' || task || ' of <n> failed' AS signature, count(*) AS n, min_by(ts, id) AS first_ts, max_by(ts, id) AS last_ts,
    min_by('task ' || task || ' of ' || user_id || ' failed', id) AS sample, false AS expected FROM run_log GROUP BY task"""))
def _(spark, sf):
    rows = run_log(spark, sf).select("ts", F.col("id").alias("ord"), F.concat(F.lit("task "), "task", F.lit(" of "), "user_id", F.lit(" failed")).alias("text"))
    return R.error_clusters(rows, X.error_signature(F.col("text")), X.expected(F.col("text")))


def _slots(spark, sf):
    span = table(spark, sf, "events").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return R.expected_slots(span, "a", "b")


_SLOTS = """slots AS (SELECT CAST(d AS DATE) AS day, CASE isodow(d) WHEN 6 THEN 'star' WHEN 7 THEN 'weekly' ELSE 'daily' END AS task
    FROM (SELECT unnest(generate_series(min(CAST(CAST(ts AS DATE) AS TIMESTAMP)), max(CAST(CAST(ts AS DATE) AS TIMESTAMP)), INTERVAL 1 DAY)) AS d FROM events))"""


@query("expected_slots", f"WITH {_SLOTS} SELECT day, task FROM slots")
def _(spark, sf):
    return _slots(spark, sf)


@query("digest_health", sql("run_log", f"""WITH {_SLOTS}, k AS (SELECT {_KIND} AS kind FROM run_log), c AS (SELECT count(*) FILTER (kind = 'published') AS published,
    count(*) FILTER (kind = 'expected_skip') AS expected_skip, count(*) FILTER (kind = 'degraded') AS degraded, count(*) FILTER (kind = 'failed') AS failed FROM k)
    SELECT (SELECT count(*) FROM slots) AS slots, c.*, round(100.0::DOUBLE * published / (SELECT count(*) FROM slots), 2) AS rate, 'ok' AS health FROM c"""))
def _(spark, sf):
    return R.digest_health(run_log(spark, sf), _slots(spark, sf))


@query("slot_success", sql("run_log", f"""WITH {_SLOTS}, p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS published FROM run_log WHERE {_KIND} = 'published' GROUP BY 1)
    SELECT s.day, s.task, coalesce(p.published, 0) AS published FROM slots s LEFT JOIN p USING (day)"""))
def _(spark, sf):
    p = run_log(spark, sf).where(R.outcome_kind() == "published").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("published"))
    return _slots(spark, sf).join(p, "day", "left").select("day", "task", F.coalesce("published", F.lit(0)).alias("published"))


_NOW = "2000-01-15 12:00:00"
#: What a disk (percent) and a certificate (days) are worth.
_BANDS = [("disk", None, 84.0, "ok"), ("disk", 85.0, 94.0, "warn"), ("disk", 95.0, None, "critical"), ("certificate", None, 14.0, "warn"), ("certificate", 15.0, None, "ok")]
_HEALTH = f"""WITH d AS (SELECT s_suppkey AS host, CASE WHEN s_suppkey % 5 > 0 THEN CAST(floor(abs(s_acctbal)) % 101 AS INTEGER) END AS pct FROM supplier),
    c AS (SELECT l_suppkey AS host, min(struct_pack(e := l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)), p := '/etc/live/d' || l_orderkey % 7 || '/cert.pem')) AS c FROM lineitem WHERE l_suppkey % 6 > 0 AND l_linenumber % 2 = 1 AND l_shipdate >= TIMESTAMP '1999-12-20' GROUP BY 1),
    k AS (SELECT host, split_part(c.p, '/', 4) AS domain, CAST(floor((epoch(c.e) - epoch(TIMESTAMP '{_NOW}')) / 86400) AS BIGINT) AS days_left FROM c),
    t AS (SELECT l_suppkey AS host, list_sort(list_distinct(list('t' || l_linenumber))) AS dead FROM lineitem WHERE l_quantity = 50 AND l_partkey % 40 = 0 GROUP BY 1),
    j AS (SELECT host, pct, domain, days_left, coalesce(dead, []) AS dead, len(coalesce(dead, [])) > 0 AS is_dead, pct >= 95 AS full_, pct BETWEEN 85 AND 94 AS near_, days_left <= 14 AS soon FROM d LEFT JOIN k USING (host) LEFT JOIN t USING (host))
    SELECT host, CASE WHEN is_dead THEN 'critical' WHEN pct IS NULL AND days_left IS NULL THEN 'unknown' WHEN coalesce(full_, false) THEN 'critical' WHEN coalesce(near_, false) OR coalesce(soon, false) THEN 'warn' ELSE 'ok' END AS status,
        pct, domain, days_left, dead, list_filter([CASE WHEN pct IS NULL THEN 'no_disk' END, CASE WHEN days_left IS NULL THEN 'no_certificate' END, CASE WHEN full_ THEN 'disk_critical' WHEN near_ THEN 'disk_warn' END,
            CASE WHEN soon THEN 'certificate_ends' END, CASE WHEN is_dead THEN 'dead_timers' END], lambda x: x IS NOT NULL) AS notes FROM j"""


def _health(spark, sf):
    """Suppliers as hosts; their line items as certificates and timers."""
    s, line = table(spark, sf, "supplier"), table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "host")
    disks = s.select(F.col("s_suppkey").alias("host"), F.expr("case when s_suppkey % 5 > 0 then cast(floor(abs(s_acctbal)) % 101 as int) end").alias("pct"))
    ends = F.expr("l_shipdate + make_dt_interval(0, cast(l_orderkey % 24 as int))").alias("ends")
    path = F.concat(F.lit("/etc/live/d"), F.col("l_orderkey") % 7, F.lit("/cert.pem")).alias("path")
    certificates = line.where("host % 6 > 0 and l_linenumber % 2 = 1 and l_shipdate >= timestamp_ntz '1999-12-20 00:00:00'").select("host", path, ends)
    timers = line.select("host", F.concat(F.lit("t"), "l_linenumber").alias("unit"), F.expr("case when l_quantity = 50 and l_partkey % 40 = 0 then if(l_linenumber % 2 = 0, 'failed', null) else 'active' end").alias("state"))
    bands = spark.createDataFrame(_BANDS, "metric string, low double, high double, status string")
    return H.host_health(disks.select("host"), disks, certificates, timers, bands, _NOW)


@query("system_health", _HEALTH)
def _(spark, sf):
    return _health(spark, sf)


@query("overall_status", f"SELECT s_nationkey, (['ok', 'unknown', 'warn', 'critical'])[max(CASE status WHEN 'critical' THEN 4 WHEN 'warn' THEN 3 WHEN 'unknown' THEN 2 ELSE 1 END)] AS status FROM ({_HEALTH}) h JOIN supplier ON s_suppkey = host GROUP BY 1")
def _(spark, sf):
    nations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("host"), "s_nationkey")
    return _health(spark, sf).join(nations, "host").groupBy("s_nationkey").agg(R.worst("status").alias("status"))


def _samples(spark, sf):
    e = table(spark, sf, "events")
    s = e.select(F.col("user_id").alias("post_id"), F.to_date("ts").alias("day"), F.col("ts").alias("sampled_at"), F.col("event_id").alias("views"))
    p = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("post_id"), F.expr("timestamp_ntz '2024-01-02 06:00:00' + make_dt_interval(0, cast(c_custkey % 48 as int))").alias("published_at"))
    return s, p


_REPORT = """s AS (SELECT user_id AS post_id, CAST(ts AS DATE) AS day, ts, event_id AS views FROM events),
    p AS (SELECT c_custkey AS post_id, TIMESTAMP '2024-01-02 06:00:00' + to_hours(CAST(c_custkey % 48 AS INTEGER)) AS published_at FROM customer WHERE c_custkey % 3 <> 0),
    j AS (SELECT s.*, (epoch_us(ts) - epoch_us(published_at)) / 3.6e9 AS age, min(day) OVER (PARTITION BY s.post_id) AS first_day FROM s LEFT JOIN p USING (post_id)),
    h AS (SELECT * FROM (SELECT post_id, views, age, row_number() OVER (PARTITION BY post_id ORDER BY abs(age - 24), age, views) AS r FROM j WHERE age BETWEEN 21 AND 27) WHERE r = 1),
    n AS (SELECT post_id, max(views) AS views FROM j WHERE day = first_day + 1 AND age IS NULL GROUP BY 1),
    rep AS (SELECT a.post_id, a.day, coalesce(h.views, n.views) AS h24, h.age, CASE WHEN h.post_id IS NOT NULL THEN 'h24_window' WHEN n.post_id IS NOT NULL THEN 'next_day_approximate' ELSE 'missing' END AS basis, a.current
        FROM (SELECT post_id, min(day) AS day, max_by(views, ts) AS current FROM j GROUP BY 1) a LEFT JOIN h USING (post_id) LEFT JOIN n USING (post_id))"""


@query("view_report_h24", f"WITH {_REPORT} SELECT post_id, day, h24, round(age, 9) AS age, basis, current FROM rep")
def _(spark, sf):
    return R.view_report(*_samples(spark, sf)).withColumn("age", F.round("age", 9))


@query("summary_split", f"""WITH {_REPORT} SELECT CASE WHEN post_id % 2 = 0 THEN 'before' ELSE 'after' END AS side, basis, count(*) AS n, count(h24) AS measured, count(*) FILTER (h24 IS NULL) AS missing,
    round(avg(h24), 6) AS mean, CAST(median(h24) AS DOUBLE) AS median, CAST(sum(h24) AS BIGINT) AS views, round(sum(CASE WHEN h24 IS NOT NULL THEN post_id % 13 END) / sum(h24), 9) AS like_rate FROM rep GROUP BY ALL""")
def _(spark, sf):
    rows = R.view_report(*_samples(spark, sf)).withColumns({"day": F.expr("case when post_id % 2 = 0 then date '2024-01-01' else date '2024-02-01' end"), "likes": F.col("post_id") % 13})
    return R.split_summary(rows, "2024-01-15", ["basis"]).withColumns({"mean": F.round("mean", 6), "like_rate": F.round("like_rate", 9)})


@query("weekly_repo_agg", """SELECT p_brand AS full_name, count(*) AS days, CAST(sum(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END) AS BIGINT) AS total_today, max(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END) AS peak_today,
    max(p_size * 10) AS stars, min_by(p_name, p_partkey) AS url, coalesce(max_by(p_type, p_partkey) FILTER (p_partkey % 3 = 0), '') AS "desc" FROM part GROUP BY 1""")
def _(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_brand").alias("full_name"), F.expr("nullif(case when p_size % 5 = 0 then 0 else p_size end, 0)").alias("today_stars"), (F.col("p_size") * 10).alias("stars"), F.col("p_name").alias("url"), F.expr("case p_partkey % 3 when 0 then p_type when 1 then '(无描述)' end").alias("desc"), F.col("p_partkey").alias("ord"))
    return R.weekly_repos(rows)


@query("category_order", "SELECT c_mktsegment AS segment, n, turn FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('AUTOMOBILE', 3), ('HOUSEHOLD', 4)) o(s, turn) ON s = c_mktsegment")
def _(spark, sf):
    order = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2), ("AUTOMOBILE", 3), ("HOUSEHOLD", 4)], "segment string, turn int")
    n = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(order), "segment").select("segment", "n", "turn")


@query("title_binding", sql("posts", r"""WITH i AS (SELECT post_id, regexp_replace(title, '[\s"''“”‘’「」『』《》]', '', 'g') AS t FROM posts), o AS (SELECT t, min(post_id) AS ord FROM i WHERE post_id % 2 = 0 GROUP BY t)
    SELECT i.post_id, 'answer ' || o.ord AS answer FROM i JOIN o USING (t)"""))
def _(spark, sf):
    p = posts(spark, sf).select("post_id", "title")
    out = p.where("post_id % 2 = 0").select(F.concat(F.lit("「"), "title", F.lit(" 」")).alias("out_title"), F.concat(F.lit("answer "), "post_id").alias("answer"), F.col("post_id").alias("ord"))
    return G.bind_by_title(p, out, G.loose).select("post_id", "answer")


@query("repo_binding", "SELECT s_suppkey, 'org/repo' || (s_suppkey % 20) AS repo, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_suppkey % 20 GROUP BY ALL")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", G.repo_name(F.concat(F.lit("https://GitHub.com/Org/Repo"), F.col("s_suppkey") % 20, F.lit("/"))).alias("repo"))
    n = table(spark, sf, "nation").select(G.repo_name(F.concat(F.lit("org/REPO"), "n_nationkey")).alias("repo"))
    return s.join(n, "repo").groupBy("s_suppkey", "repo").agg(F.count(F.lit(1)).alias("n"))


@query("rule_match", sql("run_log", "SELECT DISTINCT rule FROM (SELECT 'task ' || task || ' ' || status AS s FROM run_log), (VALUES ('a', ['DAILY', 'degraded']), ('b', ['weekly', 'nothing']), ('c', ['star'])) r(rule, ks) WHERE len(list_filter(ks, lambda k: contains(lower(s), lower(k)))) = len(ks)"))
def _(spark, sf):
    rules = spark.createDataFrame([("a", ["DAILY", "degraded"]), ("b", ["weekly", "nothing"]), ("c", ["star"])], "rule string, contains array<string>")
    return H.match_rules(rules, run_log(spark, sf).select(F.concat(F.lit("task "), "task", F.lit(" "), "status").alias("signal")))


@query("metadata_latest", sql("run_log", "SELECT user_id, max_by(tag, id) FILTER (tag IS NOT NULL) AS tag, max_by(detail, id) FILTER (id % 3 = 0) AS detail FROM run_log GROUP BY 1"))
def _(spark, sf):
    log = run_log(spark, sf).withColumn("detail", F.expr("case when id % 3 = 0 then detail end"))
    return R.latest_fields(log, "user_id", ["tag", "detail"], "id")


@query("evidence_binding", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'missing_block' WHEN doc_id % 4 = 1 THEN 'quote_not_found' END AS issue FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    blocks = d.where("doc_id % 4 <> 0").select("doc_id", F.lit("b1").alias("block_id"), "text")
    quotes = d.select("doc_id", F.lit("b1").alias("block_id"), F.expr("case when doc_id % 4 = 1 then concat(text, '#') else substring(text, 3, 20) end").alias("quote"))
    return G.bind_evidence(quotes, blocks).select("doc_id", "issue")


@query("rule_match_documents", """WITH r AS (SELECT item_id AS rule, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')[1:3]) AS ks FROM benchmark)
    SELECT rule FROM r WHERE EXISTS (SELECT 1 FROM documents WHERE text IS NOT NULL AND len(list_filter(ks, lambda k: contains(lower(text), k))) = len(ks))""")
def _(spark, sf):
    """A rule of the first three long words of each benchmark item; documents as signals."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), 1, 3)
    rules = table(spark, sf, "benchmark").select(F.col("item_id").alias("rule"), words.alias("contains"))
    return H.match_rules(rules, table(spark, sf, "documents").select(F.col("text").alias("signal")))


@query("advice_routing", """WITH s AS (SELECT r_name AS section, r_regionkey AS pos, CASE WHEN r_regionkey < 2 THEN 'ok' ELSE 'warn' END AS status FROM region),
    k(section, word) AS (VALUES ('AFRICA', 'license'), ('AMERICA', 'copyright'), ('EUROPE', '@'), ('ASIA', 'the '), ('ASIA', 'und ')),
    f AS (SELECT doc_id, min(pos) AS pos FROM documents, k JOIN s USING (section) WHERE contains(lower(text), word) GROUP BY 1),
    p AS (SELECT doc_id AS id, coalesce(f.pos, (SELECT coalesce(min(pos) FILTER (status <> 'ok'), min(pos)) FROM s)) AS pos FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN f USING (doc_id))
    SELECT id, section FROM p LEFT JOIN s USING (pos)""")
def _(spark, sf):
    """Documents as advice, regions as the sections of a report."""
    sections = table(spark, sf, "region").select(F.col("r_name").alias("section"), F.col("r_regionkey").alias("pos"), F.when(F.col("r_regionkey") < 2, "ok").otherwise("warn").alias("status"))
    routes = spark.createDataFrame([("AFRICA", "License"), ("AMERICA", "copyright"), ("EUROPE", "@"), ("ASIA", "the "), ("ASIA", "und ")], "section string, keyword string")
    return H.route_advice(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), sections, routes)


@query("verdict_gate", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unscored' WHEN event_type = 'error' THEN 'vetoed' WHEN trunc(least(10, value / 20)) >= 7 OR user_id % 11 >= 7 THEN 'featured' ELSE 'below' END AS gate FROM events")
def _(spark, sf):
    e = table(spark, sf, "events")
    content = F.expr("case when event_id % 7 = 0 then 'n/a' else cast(value / 20 as string) end")
    return e.select("event_id", G.verdict_gate(content, F.expr("cast(user_id % 11 as string)"), F.expr("case when event_type = 'error' then 'True' else 'no' end")).alias("gate"))


@query("packet_issues", "SELECT page_id, array_to_string(list_filter([CASE WHEN length(html) < 2000 THEN 'source_too_short' END, CASE WHEN page_id % 5 = 0 THEN 'source_hash_mismatch' END, CASE WHEN page_id % 3 = 0 THEN 'no_blocks' END], lambda x: x IS NOT NULL), ',') AS issues FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages")
    digest = F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.sha2("html", 256))
    return p.select("page_id", F.array_join(G.packet_issues(F.col("html"), F.col("url"), digest, F.col("page_id") % 3, 2000), ",").alias("issues"))


@query("publication_decision", """SELECT o_orderkey, CASE WHEN k = 0 THEN 'generation_error' WHEN k = 1 THEN 'skip_quality' WHEN k = 2 THEN 'generation_error' WHEN k = 3 THEN 'skip_quality'
    WHEN o_totalprice < 70000 OR o_custkey % 2 = 0 THEN 'skip_quality' ELSE 'ready' END AS decision FROM (SELECT *, o_orderkey % 8 AS k FROM orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 8)
    k = F.col("k")
    issues = F.when(k == 0, F.array(F.lit("source_hash_mismatch"))).when(k == 1, F.array(F.lit("placeholder"))).otherwise(F.array().cast("array<string>"))
    review = F.when(k == 2, "error").otherwise("pass")
    kind = F.when(k == 3, "promotion").otherwise("knowledge")
    return o.select("o_orderkey", G.publication_decision(issues, review, F.lit(True), kind, F.col("o_totalprice") / 10000, F.col("o_custkey") % 2 == 1).alias("decision"))


@query("primary_link", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://arxiv.org/abs/24.' || page_id WHEN page_id % 3 = 0 THEN 'https://github.com/a/b' END AS link FROM pages")
def _(spark, sf):
    arxiv = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/24."), "page_id", F.lit(".pdf")))
    links = F.array_compact(F.array(F.lit("https://blog.example.com/x"), arxiv, F.when(F.col("page_id") % 3 == 0, "https://github.com/a/b")))
    return table(spark, sf, "pages").select("page_id", G.primary_link(links, ["arxiv.org", "github.com"]).alias("link"))


@query("publish_outcome", "SELECT o_orderkey, CASE WHEN isodow(o_orderdate) > 5 THEN 'weekend' WHEN o_custkey % 10 = 0 THEN 'disabled' WHEN o_custkey % 7 = 0 THEN 'no_credentials' WHEN o_orderstatus = 'P' THEN 'publish_dup' WHEN o_custkey % 3 = 0 THEN 'dry_run' WHEN o_orderstatus = 'O' THEN 'published' ELSE 'failed' END AS outcome FROM orders")
def _(spark, sf):
    c = F.col("o_custkey")
    out = R.publish_outcome(F.weekday("o_orderdate") > 4, c % 10 != 0, c % 7 != 0, F.col("o_orderstatus") == "P", c % 3 == 0, F.col("o_orderstatus") == "O")
    return table(spark, sf, "orders").select("o_orderkey", out.alias("outcome"))


@query("weighted_score", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 5 <= 10 AND l_discount * 100 <= 10 THEN round(l_quantity / 5 * 0.30::DOUBLE + l_discount * 100 * 0.30::DOUBLE + l_tax * 100 * 0.25::DOUBLE + l_linenumber * 0.10::DOUBLE + 5 * 0.05::DOUBLE, 6) END AS score FROM lineitem")
def _(spark, sf):
    s = {"utility": F.col("l_quantity") / 5, "depth": F.col("l_discount") * 100, "credibility": F.col("l_tax") * 100, "audience": F.col("l_linenumber"), "novelty": F.lit(5)}
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", R.weighted_score(s).alias("score"))


@query("runlog_scan", sql("run_log", "SELECT id, task, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(regexp_extract(detail, '\\d+') AS BIGINT) END AS k FROM run_log WHERE ts >= TIMESTAMP '2024-01-15'"))
def _(spark, sf):
    log = run_log(spark, sf).where("ts >= timestamp_ntz '2024-01-15'").withColumn("raw", F.expr("case when id % 9 = 0 then '{broken' else detail end"))
    parsed = F.coalesce(F.try_parse_json("raw"), F.parse_json(F.lit("{}")))
    return log.select("id", "task", F.try_variant_get(parsed, "$.k", "bigint").alias("k"))


@query("source_fetch_stats", sql("pool", "SELECT source, count(*) AS fetched, count(points) AS scored, min_by(url, id) AS first_url FROM pool GROUP BY 1"))
def _(spark, sf):
    return pool(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.count("points").alias("scored"), F.min_by("url", "id").alias("first_url"))
