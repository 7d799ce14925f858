"""Windows over the blocks of documents: (doc, pos, kind, level, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
REPEAT_CHARS, REPEAT_COUNT, REPEAT_SPAN = 80, 3, 15
WIDGET_CHARS, QUOTE_CHARS = 60, 80
WIDGETS = (
    "微信扫码分享|点击下方按钮可复制链接|本文责编|位派友已充电|著作权归作者|"
    "未经.{0,8}许可.{0,8}转载|关注少数派小红书|少数派为你呈现|Matrix 首页推荐"
)
BOILERPLATE = ("Matrix 是少数派的写作社区", "文章代表作者个人观点")
STRUCTURE = ("table", "formula", "code")
METHOD = r"(?i)\b(?:methods?|methodology|approach|algorithm|framework|architecture|model|proof|derivation|theory)\b|方法|算法|推导|证明"
SUPPORT = r"(?i)\b(?:results?|experiments?|evaluation|measurements?|findings|proof|derivation|theorem|analysis)\b|结果|实验|测量|评估|推导|证明"
ABSTRACT = r"(?i)^(?:\d+[.\s]*)?(?:abstract|摘要)\b"
TABLE_REF, FIGURE_REF = r"(?i)\btable\s+\d+|表\s*\d+", r"(?i)\b(?:figure|fig\.)\s*\d+|图\s*\d+"
EXTRACT_CAP, SHORT = 60_000, 500


def _plain() -> Column:
    return F.col("kind").isin("paragraph", "heading")


def spam_repeats(blocks: DataFrame) -> DataFrame:
    """doc, text of short texts that stand REPEAT_COUNT times within REPEAT_SPAN positions."""
    short = blocks.where(_plain() & (F.char_length("text") <= REPEAT_CHARS))
    before = F.lag("pos", REPEAT_COUNT - 1).over(Window.partitionBy("doc", "text").orderBy("pos"))
    return short.withColumn("before", before).where(F.col("pos") - F.col("before") <= REPEAT_SPAN).select("doc", "text").distinct()


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Without repeats, widgets, boilerplate and short quoted lines."""
    text, size = F.col("text"), F.char_length("text")
    widget = (size <= WIDGET_CHARS) & text.rlike(WIDGETS)
    start = F.startswith(text, F.lit(BOILERPLATE[0])) | F.startswith(text, F.lit(BOILERPLATE[1])) | (F.startswith(text, F.lit("> ")) & (size <= QUOTE_CHARS))
    rows = blocks.join(spam_repeats(blocks).withColumn("_spam", F.lit(True)), ["doc", "text"], "left")
    return rows.where(~(_plain() & (F.coalesce("_spam", F.lit(False)) | widget | start))).drop("_spam")


def budget_cap(blocks: DataFrame, budget: int) -> DataFrame:
    """Blocks in order up to a number of characters, two between blocks; the one across the line is cut."""
    order = Window.partitionBy("doc").orderBy("pos")
    size = F.char_length("text")
    used = F.coalesce(F.sum(size + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(budget) - used
    rows = blocks.withColumn("room", room)
    return rows.where("room > 0").withColumn("cut", F.char_length("text") > F.col("room")).withColumn("text", F.expr("substring(text, 1, cast(room as int))")).drop("room")


def inherit_priority(blocks: DataFrame, words: list[str]) -> DataFrame:
    """priority 0 of structure, of blocks with one of the words, and under headings with one; else 1."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("text"), F.lit(w))
    head = F.when(F.col("kind") == "heading", F.when(hit, 0).otherwise(1))
    section = F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos")), F.lit(1))
    return blocks.withColumn("priority", F.when((section == 0) | hit | F.col("kind").isin(*STRUCTURE), 0).otherwise(1))


def evidence_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """With selected: whole blocks by (priority, pos) while they fit; a block too large is passed over.

    A fold over the ordered blocks of one document, which are few.
    """
    item = F.struct("priority", "pos", F.char_length("text").alias("size"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("ids"))
    folded = F.aggregate(
        F.array_sort(F.collect_list(item)),
        start,
        lambda s, b: F.when(s["used"] + b["size"] <= budget, F.struct((s["used"] + b["size"]).alias("used"), F.concat(s["ids"], F.array(b["pos"])).alias("ids"))).otherwise(s),
    )
    chosen = blocks.groupBy("doc").agg(folded["ids"].alias("ids")).select("doc", F.explode("ids").alias("pos")).withColumn("selected", F.lit(True))
    return blocks.join(chosen, ["doc", "pos"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def section_present(blocks: DataFrame, pattern: str) -> DataFrame:
    """doc, present: has a heading below level 1 that matches a body before the next heading of its level or above?"""
    later = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    head, level = F.col("kind") == "heading", F.least(F.coalesce("level", F.lit(6)), F.lit(6))
    body = F.col("kind").isin("paragraph", "list_item", *STRUCTURE) & (F.trim("text") != "")
    ends = F.array(*[F.min(F.when(head & (level <= n), F.col("pos"))).over(later) for n in range(1, 7)])
    end, first = F.element_at(ends, F.greatest(level, F.lit(1))), F.min(F.when(body, F.col("pos"))).over(later)
    hit = head & (level != 1) & F.col("text").rlike(pattern) & (first < F.coalesce(end, first + 1))
    return blocks.select("doc", hit.alias("hit")).groupBy("doc").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("present"))


def block_issues(blocks: DataFrame, least: int) -> DataFrame:
    """doc, issues: too_short, no_heading, unclosed_fence."""
    n = F.sum(F.char_length("text"))
    fences = F.sum(F.regexp_count("text", F.lit("```")))
    parts = F.array(F.when(n < least, "too_short"), F.when(F.count_if(F.col("kind") == "heading") == 0, "no_heading"), F.when(fences % 2 == 1, "unclosed_fence"))
    return blocks.groupBy("doc").agg(F.array_compact(parts).alias("issues"))


def article_issues(articles: DataFrame, login: str) -> DataFrame:
    """doc, issues: why the article that html_articles found (as doc) can't be used as it is; an empty list if it can.

    Papers, and what has an abstract, need a method and support; a table or figure that
    is cited needs one in text. `login` is the pattern of texts that ask to log in.
    """
    rows = clean_blocks(articles.select("doc", F.posexplode("blocks").alias("pos", "_b")).select("doc", "pos", "_b.kind", "_b.level", "_b.text"))
    kind, text, size = F.col("kind"), F.col("text"), F.char_length("text")
    bare = F.trim(F.regexp_replace(text, r"\[[^\]]*\]\([^)]*\)", ""))
    told = {
        "own": kind.isin(*STRUCTURE) | (kind.isin("paragraph", "list_item") & (F.char_length(bare) >= 25)),
        "substantive": kind.isin(*STRUCTURE) | ((kind == "paragraph") & (size >= 80) & ~text.rlike(login)),
        "abstract_head": (kind == "heading") & text.rlike(ABSTRACT),
        "table_ref": text.rlike(TABLE_REF),
        "figure_ref": text.rlike(FIGURE_REF),
        "has_table": kind == "table",
    }
    facts = rows.groupBy("doc").agg(F.sum(size).alias("chars"), F.count(F.lit(1)).alias("n"), *[F.bool_or(c).alias(k) for k, c in told.items()])
    has = lambda pattern, name: section_present(rows, pattern).withColumnRenamed("present", name)
    found = articles.select("doc", "flags").join(facts, "doc", "left").join(has(METHOD, "method"), "doc", "left").join(has(SUPPORT, "support"), "doc", "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    flag = lambda name: F.array_contains("flags", name)
    codes = lambda *pairs: F.array_compact(F.array(*[F.when(c, k) for c, k in pairs]))
    abstract, full = flag("abstract") | yes("abstract_head"), F.lit("fulltext_required")
    lacking = codes(
        (abstract & ~yes("method") & ~yes("support"), "abstract_only"),
        (~yes("method"), "missing_method"),
        (~yes("support") | (yes("table_ref") & ~yes("has_table")), "missing_support"),
        (yes("figure_ref") & ~flag("figures_told"), "critical_figure_missing"),
    )
    none = F.array().cast("array<string>")
    paper = (
        F.when(flag("pdf_link") & ~yes("own"), F.array(F.lit("pdf_fulltext_required"), full))
        .when(~flag("paper") & ~abstract, none)
        .otherwise(F.concat(lacking, F.when(F.size(lacking) > 0, F.array(full)).otherwise(none)))
    )
    gated = flag("login") & (flag("login_form") | ~yes("substantive"))
    chars, n = F.coalesce("chars", F.lit(0)), F.when(gated, 0).otherwise(F.coalesce("n", F.lit(0)))
    cut = (n > 0) & (chars + 2 * (n - 1) > EXTRACT_CAP) | flag("unclosed")
    rest = codes((gated, "login_required"), (n == 0, "empty_content"), ((n > 0) & (chars < SHORT), "short_text"), (cut, "truncated"), (cut, "fulltext_required"))
    issues = F.when(flag("pdf"), F.array(F.lit("pdf_fulltext_required"), full)).otherwise(F.array_distinct(F.concat(paper, rest)))
    return found.select("doc", issues.alias("issues"))


def provenance(blocks: DataFrame) -> DataFrame:
    """doc, blocks, source_hash of the joined text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return blocks.groupBy("doc").agg(F.count(F.lit(1)).alias("blocks"), F.sha2(F.array_join(parts, "\n\n"), 256).alias("source_hash"))
