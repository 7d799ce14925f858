"""Checks of source packets and drafts: arrays of codes, each once, in the order in which they are met.

Packets and drafts are structs (PACKET, DRAFT). A field that is null, or that was of
another type in the JSON it came from, counts as missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalake.functions.python import lint

PACKET = (
    "struct<text:string,url:string,source_hash:string,evidence_kind:string,issues:array<string>,publication_status:string,"
    "blocks:array<struct<id:string,text:string>>,evidence:array<struct<id:string,block_id:string,statement:string,quote:string>>>"
)
DRAFT = (
    "struct<schema_version:int,article_type:string,title:string,learning_question:string,opening:string,takeaway:string,limitation:string,"
    "prerequisites:array<string>,source_url:string,source_hash:string,research_checks:map<string,string>,evidence_ids:array<string>,"
    "sections:array<struct<heading:string,markdown:string,evidence_ids:array<string>>>,test_status:string,test_record:string>"
)

# Fixed values.
VERSION = 2
ARTICLE_TYPES = ("research", "mechanism", "experiment")
EVIDENCE_KINDS = ("empirical", "theoretical", "engineering_measurement")
STATUSES = ("peer_reviewed", "preprint", "technical_report", "engineering_blog", "unknown")
TESTED = ("not_independently_tested", "independently_tested")
FATAL = (
    "abstract_only", "fulltext_required", "pdf_fulltext_required", "login_required", "empty_content", "truncated", "extract_truncated",
    "missing_method", "missing_support", "critical_figure_missing", "missing_critical_figure", "unsupported_content_type",
)
REQUIRED = ("title", "learning_question", "opening", "takeaway", "limitation")
CHECKED = ("problem", "method", "support", "conditions", "limits")
LINTED = ("opening", "limitation", "takeaway", "title")

_NONE = "array<string>"


def _blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose condition is true."""
    return F.array_compact(F.array(*[F.when(c, code) for c, code in pairs]))


def _not_in(c: Column, values) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def public_url(url: Column) -> Column:
    """http or https, with a host, without a user, tabs or line ends?"""
    return F.coalesce(url.rlike(r"\A(?i:https?)://[^/?#@\s:\[\]]+(:\d*)?([/?#][^\r\n\t]*)?\z"), F.lit(False))


def source_issues(p: Column) -> Column:
    """Codes of a packet."""
    text = p["text"]
    sound = lambda b: ~_blank(b["id"]) & ~_blank(b["text"])
    each = F.transform(
        p["blocks"],
        lambda b: F.when(~F.coalesce(sound(b), F.lit(False)), "invalid_source_block").when(~F.contains(text, b["text"]), "unbound_source_block"),
    )
    ids = F.transform(F.filter(p["blocks"], lambda b: F.coalesce(sound(b), F.lit(False))), lambda b: b["id"])
    blocks = F.when(F.coalesce(F.size(p["blocks"]), F.lit(0)) <= 0, F.array(F.lit("missing_source_blocks"))).otherwise(
        F.concat(F.array_compact(each), _codes((F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_source_block")))
    )
    return F.when(p.isNull(), F.array(F.lit("missing_source"))).otherwise(
        F.array_distinct(
            F.concat(
                F.when(_blank(text), F.array(F.lit("empty_content"))).otherwise(_codes((F.coalesce(F.sha2(text, 256) != p["source_hash"], F.lit(True)), "source_hash_mismatch"))),
                _codes((~public_url(p["url"]), "invalid_source_url"), (_not_in(p["evidence_kind"], EVIDENCE_KINDS), "invalid_evidence_kind")),
                F.filter(_list(p["issues"]), lambda i: i.isin(*FATAL)),
                _codes((_not_in(F.coalesce(p["publication_status"], F.lit("unknown")), STATUSES), "invalid_publication_status")),
                blocks,
            )
        )
    )


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def lint_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Codes of each Markdown text of an array; an empty list for an absent one."""
    for batch in texts:
        yield batch.map(lambda ts: [[] if t is None else lint(t) for t in (ts if ts is not None else [])])


def bound_evidence(p: Column) -> Column:
    """struct(ids, codes): ids of evidence with a known block, a statement and, if any, a quote from that block."""
    state = f"struct<ids:{_NONE},codes:{_NONE}>"

    def step(s, e):
        block = F.try_element_at(F.filter(p["blocks"], lambda b: b["id"] == e["block_id"]), F.lit(-1))
        whole = (F.coalesce(e["id"], F.lit("")) != "") & ~F.array_contains(s["ids"], F.coalesce(e["id"], F.lit(""))) & block.isNotNull() & ~_blank(e["statement"])
        quoted = (F.coalesce(e["quote"], F.lit("")) == "") | F.coalesce(F.contains(block["text"], e["quote"]), F.lit(False))
        fail = lambda code: F.struct(s["ids"].alias("ids"), F.concat(s["codes"], F.array(F.lit(code))).alias("codes")).cast(state)
        good = F.struct(F.concat(s["ids"], F.array(e["id"])).alias("ids"), s["codes"].alias("codes")).cast(state)
        return F.when(~whole | e.isNull(), fail("missing_evidence")).when(~quoted, fail("unbound_evidence_quote")).otherwise(good)

    start = F.struct(F.array().cast(_NONE).alias("ids"), F.array().cast(_NONE).alias("codes"))
    return F.aggregate(F.coalesce(p["evidence"], F.array().cast("array<struct<id:string,block_id:string,statement:string,quote:string>>")), start, step)


def draft_issues(rows: DataFrame, draft: str = "draft", packet: str = "packet") -> DataFrame:
    """Rows with issues: the codes of a draft with its packet, those of the packet first.

    Each text is linted once and the evidence bound once; both are columns until the codes are told.
    """
    d, p = F.col(draft), F.col(packet)
    texts = F.concat(_list(F.transform(d["sections"], lambda s: s["markdown"])), F.array(*[d[f] for f in LINTED]))
    rows = rows.withColumn("_notes", lint_all(texts)).withColumn("_bound", bound_evidence(p))
    return rows.withColumn("issues", _draft_codes(d, p, F.col("_notes"), F.col("_bound"))).drop("_notes", "_bound")


def _draft_codes(d: Column, p: Column, notes: Column, bound: Column) -> Column:
    known = lambda ids: F.forall(ids, lambda i: F.coalesce(F.array_contains(bound["ids"], i), F.lit(False)))
    n = F.coalesce(F.size(d["sections"]), F.lit(0))
    whole = lambda s: F.coalesce(~_blank(s["heading"]) & ~_blank(s["markdown"]), F.lit(False))
    sections = F.flatten(
        F.transform(
            d["sections"],
            lambda s, i: F.when(~whole(s), F.array(F.lit("invalid_section"))).otherwise(F.concat(_codes((~known(_list(s["evidence_ids"])), "missing_evidence")), F.get(notes, i))),
        )
    )
    cited = F.exists(d["sections"], lambda s: whole(s) & known(_list(s["evidence_ids"])) & (F.size(_list(s["evidence_ids"])) > 0))
    checks = F.array(*[F.try_element_at(d["research_checks"], F.lit(k)) for k in CHECKED])
    status = d["test_status"]
    own = F.concat(
        _codes(
            (F.coalesce(d["schema_version"] != VERSION, F.lit(True)), "invalid_schema_version"),
            (_not_in(d["article_type"], ARTICLE_TYPES), "excluded_article_type"),
            *[(_blank(d[f]), f"missing_{f}") for f in REQUIRED],
            (d["prerequisites"].isNull() | F.exists(d["prerequisites"], lambda x: x.isNull()), "invalid_prerequisites"),
            (~d["source_url"].eqNullSafe(p["url"]) | ~d["source_hash"].eqNullSafe(p["source_hash"]), "draft_source_mismatch"),
            (F.exists(checks, _blank), "missing_research_checks"),
        ),
        bound["codes"],
        _codes((F.coalesce(F.size(d["evidence_ids"]) <= 0, F.lit(True)) | ~known(_list(d["evidence_ids"])), "missing_evidence")),
        F.when(n <= 0, F.array(F.lit("missing_sections"))).otherwise(F.concat(sections, _codes((~F.coalesce(cited, F.lit(False)), "missing_evidence")))),
        _codes((_not_in(status, TESTED), "invalid_test_status"), ((status == TESTED[1]) & (F.coalesce(d["test_record"], F.lit("")) == ""), "missing_test_record")),
        F.flatten(F.slice(notes, F.greatest(n, F.lit(0)) + 1, len(LINTED))),
    )
    return (
        F.when(p.isNull(), F.array(F.lit("missing_source")))
        .when(d.isNull(), F.concat(source_issues(p), F.array(F.lit("missing_draft"))))
        .otherwise(F.array_distinct(F.concat(source_issues(p), own)))
    )


def combine_decisions(producer: Column, producer_reasons: Column, gate: Column, gate_reasons: Column, complete: Column) -> Column:
    """struct(status, reasons): ready only if the producer and the gate say so and the result is complete."""
    states = ("ready", "skip_quality", "generation_error")
    said, found = _list(producer_reasons), _list(gate_reasons)
    out = lambda status, reasons: F.struct(status.alias("status"), reasons.alias("reasons"))
    error = F.lit("generation_error")
    return (
        F.when(_not_in(gate, states), out(error, F.concat(said, F.array(F.lit("invalid_gate_result")))))
        .when(_not_in(producer, states), out(error, F.concat(said, found, F.array(F.lit("invalid_pipeline_result")))))
        .when(producer != "ready", out(producer, F.concat(said, found)))
        .when(~F.coalesce(complete, F.lit(False)), out(error, F.concat(said, found, F.array(F.lit("malformed_ready_result")))))
        .otherwise(out(gate, F.concat(said, found)))
    )
