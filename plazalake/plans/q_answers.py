"""Recorded model answers, bound to what they were asked about."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazalake.functions import text as X
from plazalake.operators import answers as A
from plazalake.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


@query("post_headline", """WITH h AS (SELECT doc_id, '数据平台' || repeat('长', doc_id % 40) AS zh, 'word ' || doc_id || repeat('x', doc_id % 20) AS title FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN length(zh) > 32 THEN substring(zh, 1, 32) || '…' ELSE zh END WHEN length(title) <= 24 THEN title WHEN doc_id % 5 = 0 THEN '主题' ELSE '' END AS headline FROM h""")
def _(spark, sf):
    part = lambda sign, n: F.expr(f"repeat('{sign}', cast(doc_id % {n} as int))")
    zh = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("标签：数据平台"), part("长", 40), F.lit("。。")))
    title, theme = F.concat(F.lit("word "), "doc_id", part("x", 20)), F.when(F.col("doc_id") % 5 == 0, "【甲】主题等")
    return table(spark, sf, "documents").select("doc_id", X.post_headline(zh, title, theme).alias("headline"))


@query("clip_text", r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
    p AS (SELECT *, regexp_replace(regexp_extract(substring(t, 1, 200), '(?s)^(.{66,})[，。！？；：、,.!?;:]', 1), '[，,、；;：: ]+$', '') AS part FROM t)
    SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN part <> '' THEN part ELSE substring(t, 1, 200) END AS text FROM p""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clip(F.col("text"), 200).alias("text"))


_NOTES = "WITH c AS (SELECT c_custkey AS day, c_custkey % 5 AS k, max(o_orderkey) AS idx, max_by(o_orderstatus, o_orderkey) AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


@query("model_picks", f"""{_NOTES}, i AS (SELECT *, CASE WHEN k = 0 THEN 'no_object' WHEN k = 1 OR idx IS NULL THEN 'unbound_title' WHEN k = 2 THEN 'short_note' WHEN k = 3 AND status = 'O' THEN 'unrelated_note' END AS issue FROM c)
    SELECT day, issue, CASE WHEN issue IS NULL THEN idx END AS idx, CASE WHEN issue IS NULL THEN CASE WHEN k = 3 THEN repeat('无关的文字', 10) ELSE '向量检索系统' || repeat('很好的说明', 10) END END AS why,
    CASE WHEN issue IS NULL THEN CASE WHEN day % 2 = 0 THEN '' ELSE repeat('向量检索的导读。', 20) END END AS digest, CASE WHEN issue IS NULL THEN 'a,b,c' END AS post_titles FROM i""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    summary = F.when(F.col("o_orderstatus") == "O", "向量检索系统").otherwise("plain")
    candidates = o.select(F.col("o_custkey").alias("day"), F.col("o_orderkey").alias("idx"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), summary.alias("summary"))
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("idx"))
    c = table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left")
    k = F.col("c_custkey") % 5
    title = F.when(k == 1, "order none").otherwise(F.concat(F.lit("「ORDER "), "idx", F.lit("」")))
    why = F.when(k == 2, "短").when(k == 3, "无关的文字" * 10).otherwise(" 向量检索系统" + "很好的说明" * 10)
    digest = F.when(F.col("c_custkey") % 2 == 0, "短").otherwise("向量检索的导读。" * 20)
    titles = F.array(*[F.lit(t) for t in (" a ", "", "b", "c", "d")])
    answer = F.to_json(F.struct(title.alias("title"), why.alias("why"), digest.alias("digest"), titles.alias("post_titles")))
    answers = c.select(F.col("c_custkey").alias("day"), F.when(k == 0, "[1]").otherwise(F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).alias("answer"))
    return A.picks(answers, candidates).withColumn("post_titles", F.array_join("post_titles", ","))


@query("repo_descriptions", "SELECT s_nationkey AS day, 'Org/Repo' || s_suppkey AS title, CASE WHEN s_suppkey % 3 = 1 THEN '中文' || repeat('长', 58) ELSE '简介' || s_suppkey END AS description FROM supplier WHERE s_suppkey % 3 > 0")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    value = F.when(F.col("s_suppkey") % 3 == 0, "english only").when(F.col("s_suppkey") % 3 == 1, "中文" + "长" * 80).otherwise(F.concat(F.lit(" 简介"), "s_suppkey"))
    entry = F.struct(F.concat(F.lit("https://github.com/org/REPO"), "s_suppkey", F.lit("/")), value)
    answers = s.groupBy(F.col("s_nationkey").alias("day")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("trending_desc"))).alias("answer"))
    return A.repo_descriptions(answers, s.select(F.col("s_nationkey").alias("day"), F.concat(F.lit("Org/Repo"), "s_suppkey").alias("title")))


@query("review_sections", """WITH d AS (SELECT doc_id, doc_id % 8 AS week, 'news ' || doc_id AS title, 'https://n/' || doc_id AS url, strftime(DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER), '%-m/%-d') AS date FROM documents WHERE doc_id % 8 % 4 > 0),
    r AS (SELECT week, 'review' AS kind, row_number() OVER (PARTITION BY week ORDER BY doc_id) AS pos, title, CASE WHEN doc_id % 2 = 0 THEN 'text 日报' ELSE 'text（见 ' || date || ' 日报）' END AS text, CASE WHEN doc_id % 5 = 1 THEN 'AI 工具' ELSE '前端' END AS category, url, date FROM d WHERE doc_id % 7 > 0 AND doc_id % 5 > 0),
    p AS (SELECT week, 'pick' AS kind, row_number() OVER (PARTITION BY week ORDER BY doc_id) AS pos, title, 'reason ' || doc_id AS text, NULL AS category, url, date FROM d WHERE doc_id % 9 > 0),
    o AS (SELECT DISTINCT week, 'outlook' AS kind, pos, NULL AS title, text, NULL AS category, NULL AS url, NULL AS date FROM d, (VALUES (1, '预计 a'), (2, '预计 b')) v(pos, text))
    SELECT * FROM r UNION ALL SELECT * FROM p WHERE pos <= 3 UNION ALL SELECT * FROM o""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 8).alias("week"), F.concat(F.lit("news "), "doc_id").alias("title"))
    news = d.select("week", "title", F.concat(F.lit("https://n/"), "doc_id").alias("url"), F.expr("date_add(date '2024-01-01', cast(doc_id % 28 as int))").alias("first_date"))
    category = F.when(F.col("doc_id") % 5 == 0, "nonsense").when(F.col("doc_id") % 5 == 1, "AI工具").otherwise("前端")
    text = F.when(F.col("doc_id") % 2 == 0, "text 日报").otherwise("text ")
    said = F.when(F.col("doc_id") % 7 > 0, F.struct("doc_id", F.concat(F.lit("《"), "title", F.lit("》")).alias("title"), text.alias("text"), category.alias("category")))
    pick = F.struct("doc_id", "title", F.concat(F.lit("reason "), "doc_id").alias("reason"))
    outlook = F.when(F.col("week") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("预计 a"), F.lit(" "), F.lit("b")))
    lists = d.groupBy("week").agg(F.array_sort(F.collect_list(said)).alias("review"), F.array_sort(F.collect_list(pick)).alias("picks"))
    answers = lists.select("week", F.concat(F.lit("Here: "), F.to_json(F.struct("review", "picks", outlook.alias("outlook"))), F.lit(" .")).alias("answer"))
    return A.review_sections(answers, news, d.where("doc_id % 9 = 0"))
