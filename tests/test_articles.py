"""Articles in pages, and why they can't be used."""

from __future__ import annotations

import pyarrow as pa
import pytest

from plazalake.operators import blocks, html

P = "<p>" + "A sentence of prose that goes on for a while. " * 12 + "</p>"
FULL = ["fulltext_required"]
PAGES = {
    P: [],
    None: ["empty_content"],
    " %PDF-1.7": ["pdf_fulltext_required", *FULL],
    "<p>short</p>": ["short_text"],
    '<p><a href="/a.PDF?x">pdf</a></p>': ["pdf_fulltext_required", *FULL, "short_text"],
    f"<h2>Abstract</h2>{P}": ["abstract_only", "missing_method", "missing_support", *FULL],
    f'<article class="ltx_document"><h2>Method</h2>{P}<h2>Results</h2>{P}</article>': [],
    f'<article class="ltx_document"><h2>Method</h2><h2>Results</h2>{P}</article>': ["missing_method", *FULL],
    f'<article class="ltx_document"><h2>Method</h2>{P}<h2>Results</h2>{P}<p>See Table 2 there.</p></article>': ["missing_support", *FULL],
    f'<article class="ltx_document"><h2>Method</h2>{P}<h2>Results</h2>{P}<p>See Fig. 2.</p><figure><img src="x"></figure></article>': ["critical_figure_missing", *FULL],
    f'<article class="ltx_document"><h2>Method</h2>{P}<h2>Results</h2>{P}<p>See Fig. 2.</p><figure><pre>1 2</pre></figure></article>': [],
    "<p>Please sign in to read this</p>": ["login_required", "empty_content"],
    f"<div>{P}<form>Log in to continue</form></div>": ["login_required", "empty_content"],
    f"<article>{P}": ["truncated", *FULL],
    f"<p>{'x' * 60_001}</p>": ["truncated", *FULL],
}


def test_article_issues(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "doc int, html string")
    found = {r.doc: r.issues for r in blocks.article_issues(html.html_articles(pages, "doc"), html.LOGIN).collect()}
    assert [found[i] for i in range(len(PAGES))] == list(PAGES.values())


@pytest.mark.parametrize(
    "page,method,texts",
    [
        (f"<article><p>teaser</p></article><article><h2>Own</h2>{P}</article>", "generic_article", 2),
        (f'<article>{P}</article><div class="post-content"><p>{"y" * 30}</p></div>', "site_selector", 1),
        (f'<article></article><main>{P}{P}</main>', "generic_main", 2),
        (f"<body>{P}</body>", "body_fallback", 1),
    ],
)
def test_body_with_most_to_say(page, method, texts):
    found = html.article(page)
    assert found[0] == method and len(found[3]) == texts


SF = "/root/testdata/sf0.001"


def pages_of(spark):
    return {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_meta_of_every_page(spark):
    """Against another reading of the same tags."""
    from html import unescape
    from html.parser import HTMLParser

    from plazalake.plans import registry

    class Meta(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = {}

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            name = a.get("property") or a.get("name")
            if tag == "meta" and name and a.get("content"):
                self.found.setdefault(name.strip().lower(), unescape(a["content"]).strip())

    got = {r.page_id: {m.key.lower(): m.value for m in r.meta} for r in registry.queries()["html_meta"](spark, SF).collect()}
    pages, some = pages_of(spark), 0
    assert set(got) == set(pages)
    for page_id, text in pages.items():
        reader = Meta()
        reader.feed(text or "")
        for name, value in reader.found.items():
            if name in got[page_id]:
                some += 1
                assert got[page_id][name].strip() == value
    assert some or not any(got.values())


def test_summary_of_every_page(spark):
    import re
    from html import unescape

    from plazalake.plans import registry

    got = {r.page_id: r.summary for r in registry.queries()["html_unescape"](spark, SF).collect()}
    pages = pages_of(spark)
    assert set(got) == set(pages)
    for page_id, text in pages.items():
        want = None if text is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", unescape(re.sub(r"<[^>]*>", " ", text))).strip(" ")[:300]
        assert got[page_id] == want


def test_issues_of_every_cleaned_page(spark):
    import re

    from plazalake.plans import registry

    rows: dict = {}
    for r in registry.queries()["html_blocks"](spark, SF).collect():
        rows.setdefault(r.page_id, []).append((r.pos, r.kind, r.text))
    want = {}
    for doc, found in rows.items():
        short: dict = {}
        for pos, kind, text in sorted(found):
            if kind in ("paragraph", "heading") and len(text) <= blocks.REPEAT_CHARS:
                short.setdefault(text, []).append(pos)
        spam = {t for t, at in short.items() if any(b - a <= blocks.REPEAT_SPAN for a, b in zip(at, at[blocks.REPEAT_COUNT - 1 :], strict=False))}

        def goes(kind, text, spam=spam):
            if kind not in ("paragraph", "heading"):
                return False
            widget = len(text) <= blocks.WIDGET_CHARS and re.search(blocks.WIDGETS, text)
            return text in spam or bool(widget) or text.startswith(blocks.BOILERPLATE) or (text.startswith("> ") and len(text) <= blocks.QUOTE_CHARS)

        kept = [(k, t) for _, k, t in found if not goes(k, t)]
        if kept:
            n = sum(len(t) for _, t in kept)
            fences = sum(t.count("```") for _, t in kept)
            want[doc] = [c for c, on in (("too_short", n < 500), ("no_heading", all(k != "heading" for k, _ in kept)), ("unclosed_fence", fences % 2 == 1)) if on]
    got = {r.doc: r.issues for r in registry.queries()["html_clean_issues"](spark, SF).collect()}
    assert got == want and want


def test_pages_are_parsed_in_small_pieces(spark):
    seen = {}

    class Pages:
        schema = spark.range(0).withColumnRenamed("id", "page_id").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            seen["run"] = run

    html.html_articles(Pages())
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(64)), "html": ["<p>" + "word " * 13_000] * 64})
    assert max(b.num_rows for b in seen["run"]([batch])) <= 16  # of 65 kB each
