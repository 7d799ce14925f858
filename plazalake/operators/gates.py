"""Deterministic gates over recorded model verdicts, drafts and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazalake.functions.text import score_clamp


def verdict_gate(content: Column, comment: Column, flame: Column, threshold: int = 7) -> Column:
    """unscored, vetoed, featured or below."""
    cv, mv = score_clamp(content), score_clamp(comment)
    return (
        F.when(cv.isNull() | mv.isNull(), "unscored")
        .when(F.coalesce(F.lower(flame) == "true", F.lit(False)), "vetoed")
        .when((cv >= threshold) | (mv >= threshold), "featured")
        .otherwise("below")
    )


def bind_by_title(inputs: DataFrame, outputs: DataFrame, normal) -> DataFrame:
    """Model output joined to its input on a normal form of the title; outputs for no input go, of several the first by ord stays."""
    out = outputs.withColumn("_t", normal(F.col("out_title"))).groupBy("_t").agg(F.min_by(F.struct("answer"), "ord")["answer"].alias("answer"))
    return inputs.withColumn("_t", normal(F.col("title"))).join(out, "_t").drop("_t")


def loose(title: Column) -> Column:
    """Without white space and quotation marks."""
    return F.regexp_replace(title, "[\\s\"'“”‘’「」『』《》]", "")


def repo_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"^(?i:https?://)?(?i:www\.)?(?i:github\.com)/", ""), "^/+|/+$", ""))


def bind_evidence(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each quote with missing_block, quote_not_found or null: its block must exist and hold it."""
    b = blocks.select("doc_id", "block_id", F.col("text").alias("_text"))
    joined = quotes.join(b, ["doc_id", "block_id"], "left")
    issue = F.when(F.col("_text").isNull(), "missing_block").when(~F.contains("_text", F.col("quote")), "quote_not_found")
    return joined.withColumn("issue", issue).drop("_text")


def packet_issues(text: Column, url: Column, digest: Column, blocks: Column, least: int = 500) -> Column:
    """Error codes of a source packet, in a fixed order."""
    checks = {
        "source_too_short": F.char_length(F.coalesce(text, F.lit(""))) < least,
        "invalid_url": ~F.coalesce(url.rlike("^https?://[^/]+"), F.lit(False)),
        "source_hash_mismatch": F.coalesce(F.sha2(text, 256) != digest, F.lit(True)),
        "no_blocks": F.coalesce(blocks, F.lit(0)) == 0,
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))


def publication_decision(issues: Column, review: Column, bound: Column, kind: Column, score: Column, floor: Column) -> Column:
    """generation_error, skip_quality or ready."""
    integrity = F.array(F.lit("source_hash_mismatch"), F.lit("draft_source_mismatch"))
    return (
        F.when(F.arrays_overlap(issues, integrity), "generation_error")
        .when(F.size(issues) > 0, "skip_quality")
        .when(review.isNull() | (review == "error") | ~bound, "generation_error")
        .when(kind != "knowledge", "skip_quality")
        .when(score.isNull(), "generation_error")
        .when((review != "pass") | (score < 7) | ~floor, "skip_quality")
        .otherwise("ready")
    )


def primary_link(links: Column, hosts: list[str]) -> Column:
    """The first link to a host of the list; arXiv PDF paths become abstract pages."""
    ok = F.filter(links, lambda u: F.coalesce(F.lower(F.try_parse_url(u, F.lit("HOST"))).isin(hosts), F.lit(False)))
    return F.regexp_replace(F.get(ok, F.lit(0)), r"(arxiv\.org)/pdf/([^?#]+?)(\.pdf)?$", "$1/abs/$2")


def glossary(answer: Column, signs: str = "一-鿿", most: int = 3) -> Column:
    """Terms of 2 to 40 characters with explanations of 10 and more that hold one of `signs`; the first ones, cut to 120."""
    rows = F.try_variant_get(F.try_parse_json(answer), "$.glossary", "array<struct<term:string,expl:string>>")
    clean = F.transform(rows, lambda g: F.struct(F.trim(g["term"]).alias("term"), F.trim(g["expl"]).alias("expl")))
    good = F.filter(clean, lambda g: F.char_length(g["term"]).between(2, 40) & (F.char_length(g["expl"]) >= 10) & g["expl"].rlike(f"[{signs}]"))
    cut = F.transform(good, lambda g: F.struct(g["term"].alias("term"), F.substring(g["expl"], 1, 120).alias("expl")))
    return F.coalesce(F.slice(cut, 1, most), F.array().cast("array<struct<term:string,expl:string>>"))


def qualified(kind: Column, purpose: Column, kinds: list[str], score: Column, floor: Column) -> Column:
    """A known article type made for knowledge, 7 or more, with no dimension below its floor."""
    return F.coalesce(kind.isin(kinds) & (purpose == "knowledge") & (score >= 7) & floor, F.lit(False))


def body_issues(markdown: Column, most: int = 20_000) -> Column:
    """Codes of a body that wouldn't survive publication unchanged."""
    checks = {
        "empty_markdown": F.coalesce(F.trim(markdown), F.lit("")) == "",
        "publication_body_not_normalized": F.coalesce(markdown != F.regexp_replace(markdown, r"^\s+|\s+\z", ""), F.lit(False)),
        "publication_body_too_long": F.coalesce(F.char_length(markdown) > most, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))
