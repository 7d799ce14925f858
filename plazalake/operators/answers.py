"""What recorded model answers may contribute: each is bound to the rows it was asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazalake.functions.text import CJK_RUN, brace_slice, clip, content_related, strip, unwrap
from plazalake.operators.gates import repo_name

# The categories of a review and what its sentences carry.
CATEGORIES = ["AI 工具", "前端", "后端", "安全", "其他"]
CITED, FORECAST = "日报", "预计"


def parsed(answer: Column) -> Column:
    """An answer as a variant, without the code fence around it; null for what isn't JSON."""
    return F.try_parse_json(F.regexp_replace(strip(answer), r"(?is)\A`{3,}(?:json)?\s*(.*?)\s*`*\z", "$1"))


def _field(v: Column, path: str, kind: str = "string") -> Column:
    found = F.try_variant_get(v, path, kind)
    return strip(found) if kind == "string" else found


def picks(answers: DataFrame, candidates: DataFrame, least_note: int = 40, most_note: int = 400, least_digest: int = 100, most_digest: int = 1200, most_titles: int = 3) -> DataFrame:
    """day, issue, idx, why, digest, post_titles: the candidate that each answer (day, answer) picked.

    candidates: day, idx, title, summary. Titles are compared without case and marks
    around them; of equal ones the least idx counts. issue: no_object, unbound_title,
    short_note or unrelated_note, and then the rest is null. Notes on candidates
    without CJK characters can't be compared with them and pass. A digest that is
    short or unrelated is empty.
    """
    v = F.col("_v")
    key = lambda title: F.lower(strip(title))
    first = candidates.groupBy("day", key(F.col("title")).alias("_key")).agg(F.min(F.struct("idx", "title", "summary")).alias("_c"))
    rows = answers.withColumn("_v", parsed(F.col("answer"))).select(
        "day",
        F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("_object"),
        key(unwrap(_field(v, "$.title"))).alias("_key"),
        _field(v, "$.why").alias("why"),
        _field(v, "$.digest").alias("digest"),
        F.transform(F.coalesce(_field(v, "$.post_titles", "array<string>"), F.array().cast("array<string>")), strip).alias("post_titles"),
    )
    signs = lambda c: F.coalesce(F.col(f"_c.{c}").rlike(CJK_RUN), F.lit(False))
    related = lambda text: ~(signs("title") | signs("summary")) | content_related(F.col("_c.title"), F.col("_c.summary"), text)
    issue = (
        F.when(~F.col("_object"), "no_object")
        .when(F.col("_c").isNull(), "unbound_title")
        .when(F.char_length("why") < least_note, "short_note")
        .when(~related(F.col("why")), "unrelated_note")
    )
    good = (F.char_length("digest") >= least_digest) & related(F.col("digest"))
    sound = lambda c: F.when(F.col("issue").isNull(), c)
    return rows.join(first, ["day", "_key"], "left").withColumn("issue", issue).select(
        "day",
        "issue",
        sound(F.col("_c.idx")).alias("idx"),
        sound(clip(F.col("why"), most_note)).alias("why"),
        sound(F.when(good, clip(F.col("digest"), most_digest)).otherwise("")).alias("digest"),
        sound(F.slice(F.filter("post_titles", lambda t: t != ""), 1, most_titles)).alias("post_titles"),
    )


def repo_descriptions(answers: DataFrame, trending: DataFrame, most: int = 60) -> DataFrame:
    """day, title, description: what answers (day, answer) say of the repositories in trending (day, title).

    Names are compared without host, slashes and case; descriptions without CJK
    characters go. Of several for one repository the last by its key stays.
    """
    said = answers.select("day", F.explode(_field(parsed(F.col("answer")), "$.trending_desc", "map<string,string>")).alias("name", "value"))
    said = said.withColumn("value", strip(F.col("value"))).where(F.col("value").rlike(CJK_RUN))
    said = said.groupBy("day", repo_name(F.col("name")).alias("_name")).agg(F.max_by("value", "name").alias("value"))
    named = trending.groupBy("day", repo_name(F.col("title")).alias("_name")).agg(F.min("title").alias("title"))
    return named.join(said, ["day", "_name"]).select("day", "title", F.substring("value", 1, most).alias("description"))


def review_sections(answers: DataFrame, news: DataFrame, deep: DataFrame, least_reviews: int = 5, most_picks: int = 3, most_outlooks: int = 5) -> DataFrame:
    """week, kind (review, pick, outlook), pos, title, text, category, url, date of sound answers (week, answer).

    news: week, title, url, first_date; deep: week, title of what has an article of
    its own. Reviews and picks must bear the title of a piece of news, reviews a known
    category as well; a date is added to reviews that cite none. An answer with fewer
    than least_reviews reviews, or without a pick or an outlook, gives no row at all.
    """
    v, cell = F.try_parse_json(brace_slice(F.col("answer"))), lambda x, name: _field(x, f"$.{name}")
    listed = lambda name: F.coalesce(_field(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
    item = lambda kind, i, title, text, category: F.struct(F.lit(kind).alias("kind"), i.alias("ord"), title.alias("title"), text.alias("text"), category.alias("category"))
    none = F.lit(None).cast("string")
    items = F.concat(
        F.transform(listed("review"), lambda x, i: item("review", i, strip(unwrap(cell(x, "title"))), cell(x, "text"), F.replace(cell(x, "category"), F.lit(" "), F.lit("")))),
        F.transform(listed("picks"), lambda x, i: item("pick", i, strip(unwrap(cell(x, "title"))), cell(x, "reason"), none)),
        F.transform(listed("outlook"), lambda x, i: item("outlook", i, none, _field(x, "$"), none)),
    )
    known = F.create_map(*[F.lit(x) for c in CATEGORIES for x in (c.replace(" ", ""), c)])
    one = news.groupBy("week", "title").agg(F.max(F.struct("first_date", "url")).alias("_n"))
    own = deep.select("week", "title").distinct().withColumn("_deep", F.lit(True))
    rows = answers.select("week", F.explode(items).alias("_i")).select("week", "_i.*").where("text <> ''")
    rows = rows.join(one, ["week", "title"], "left").join(own, ["week", "title"], "left").withColumn("category", F.try_element_at(known, F.coalesce("category", F.lit(""))))
    rows = rows.where("kind = 'outlook' or _n is not null and (kind = 'pick' and _deep is null or kind = 'review' and category is not null)")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("week", "kind").orderBy("ord")))
    rows = rows.where(F.col("pos") <= F.expr(f"case kind when 'pick' then {int(most_picks)} when 'outlook' then {int(most_outlooks)} else pos end"))
    week = Window.partitionBy("week")
    n = lambda kind: F.sum((F.col("kind") == kind).cast("int")).over(week)
    rows = rows.withColumn("_sound", (n("review") >= least_reviews) & (n("pick") > 0) & (n("outlook") > 0)).where("_sound")
    date = F.date_format("_n.first_date", "M/d")
    text = (
        F.when((F.col("kind") == "review") & ~F.contains("text", F.lit(CITED)), F.concat("text", F.lit("（见 "), date, F.lit(" 日报）")))
        .when((F.col("kind") == "outlook") & ~F.startswith("text", F.lit(FORECAST)), F.concat(F.lit(FORECAST + " "), "text"))
        .otherwise(F.col("text"))
    )
    return rows.select("week", "kind", "pos", "title", text.alias("text"), "category", F.col("_n.url").alias("url"), date.alias("date"))
