"""Article blocks of HTML pages: a tolerant parser in tasks, everything after it on rows."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazalake.sources.payloads import by_bytes

# Tags and names that hold no article text.
SKIP = frozenset(("head", "script", "style", "nav", "footer", "header", "aside", "noscript", "form", "button", "svg", "iframe", "select", "template"))
JUNK_CLASS = re.compile(
    r"comment|sidebar|newsletter|subscribe|share|footer|popover|promo|banner|copyright|related|recommend|toolbar|breadcrumb|author-card|"
    r"article__important|article__charge|article__header|advertisement|(?:^|[\s_-])ads?(?:$|[\s_-])",
    re.I,
)
JUNK_ID = re.compile(r"comment|sidebar|newsletter|subscribe", re.I)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "table": "table", "figcaption": "caption", "math": "formula", **{f"h{i}": "heading" for i in range(1, 7)}}
LOOSE = frozenset(("div", "section", "blockquote", "td", "th", "tr", "ul", "ol", "figure", "article", "main", "body"))
BODIES = {"article": 3, "main": 2, "body": 1}
NAMED_BODIES = frozenset(("post-content", "gh-content", "article__main__content", "crayons-article__body"))
PAPER, ABSTRACTS = "ltx_document", frozenset(("abstract", "ltx_abstract"))
METHODS = {4: "site_selector", 3: "generic_article", 2: "generic_main"}
CLOSING = frozenset(("article", "section", "div", "main"))
LOGIN = r"(?i)请登录后阅读|登录.{0,6}(?:阅读|查看全文)|(?:log\s*in|sign\s*in).{0,20}(?:read|continue)|subscribe to (?:read|continue)"
FIGURES = frozenset(("table", "formula", "code"))


class _Part:
    """An element that may hold an article, a figure or a form."""

    def __init__(self, tag: str, classes: set[str], chain: list[int], seen: bool):
        own = 4 if (tag in ("section", "div") and classes & NAMED_BODIES) or (tag == "article" and PAPER in classes) else BODIES.get(tag, 0)
        self.tag, self.chain, self.seen, self.rank = tag, chain, seen, own
        self.closed = self.graphic = self.textual = False


class _Blocks(HTMLParser):
    """Blocks with the numbers of the parts they are in; p and li end by the next block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.parts: list[_Part] = []
        self.blocks: list[list] = []
        self.marks: list[tuple[list[int], str]] = []
        self.raw: list[tuple[list[int], str]] = []
        self.meta: dict[str, str] = {}
        self.text: list[str] = []
        self.links: list[str] = []
        self.kind, self.level = "paragraph", None

    def _chain(self) -> list[int]:
        return [part for *_, part in self.stack if part >= 0]

    def _seen(self) -> bool:
        return not any(junk for _, junk, _ in self.stack)

    def _flush(self):
        raw = "".join(self.text)
        text = raw.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", raw).strip()
        if text and self._seen():
            self.blocks.append([self._chain(), self.kind, self.level, text, self.links])
            for i in self._chain():
                self.parts[i].textual |= self.kind in FIGURES
        self.text, self.links, self.kind, self.level = [], [], "paragraph", None

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (named.get("property") or named.get("name") or named.get("itemprop") or "").lower()
            if name and name not in self.meta:
                self.meta[name] = named.get("content", "")
        if tag in KINDS or tag in LOOSE:
            inside = self.kind in ("table", "code") and any(t in ("table", "pre") for t, *_ in self.stack)
            if not inside:
                self._flush()
            if tag in ("p", "li") or tag in KINDS:
                while self.stack and self.stack[-1][0] == "p":
                    self.stack.pop()
            if tag == "li":
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in ("ul", "ol"):
                        break
                    if self.stack[i][0] == "li":
                        del self.stack[i:]
                        break
            if tag in KINDS and not inside:
                self.kind, self.level = KINDS[tag], int(tag[1]) if KINDS[tag] == "heading" else None
        if tag == "br" or tag in ("td", "th"):
            self.text.append("\n" if self.kind == "code" else " ")
        if tag == "a" and named.get("href"):
            self.links.append(named["href"])
        if tag not in VOID:
            junk = tag in SKIP or "hidden" in named or bool(JUNK_CLASS.search(named.get("class", "")) or JUNK_ID.search(named.get("id", "")))
            if junk and self.text:
                kind, level = self.kind, self.level
                self._flush()
                self.kind, self.level = kind, level
            self.stack.append((tag, junk and tag not in ("body", "html"), self._part(tag, set(named.get("class", "").split()))))
        self._mark(tag, named)

    def _part(self, tag: str, classes: set[str]) -> int:
        if tag not in CLOSING | {"body", "figure", "form"}:
            return -1
        number = len(self.parts)
        self.parts.append(_Part(tag, classes, [*self._chain(), number], self._seen()))
        return number

    def _mark(self, tag: str, named: dict[str, str]):
        """What the issues of an article are told from."""
        if tag in ("img", "svg"):
            for i in self._chain():
                self.parts[i].graphic = True
        if not self._seen():
            return
        classes = set(named.get("class", "").split())
        hits = {"pdf_link": tag == "a" and re.search(r"(?i)\.pdf(?:[?#]|$)", named.get("href", "")), "paper": PAPER in classes, "abstract": classes & ABSTRACTS}
        self.marks += [(self._chain(), name) for name, hit in hits.items() if hit]

    def handle_endtag(self, tag):
        if not any(t == tag for t, *_ in self.stack):
            return
        if tag in KINDS or tag in LOOSE or tag in SKIP:
            inside = self.kind in ("table", "code") and tag not in ("table", "pre") and any(t in ("table", "pre") for t, *_ in self.stack)
            if not inside:
                self._flush()
        while self.stack:
            name, _, part = self.stack.pop()
            if name == tag:
                if part >= 0:
                    self.parts[part].closed = True
                break

    def handle_data(self, data):
        self.raw.append((self._chain(), data))
        if self._seen():
            self.text.append(data)

    def close(self):
        super().close()
        self._flush()


def _body(parser: _Blocks) -> tuple[int, str]:
    """The part that holds the article, -1 for the page, and how it was found.

    Named bodies go before articles, these before main; among equals the one with the
    most prose counts, 80 for each heading, code, table or formula.
    """
    scores = [[0, 0] for _ in parser.parts]
    for chain, kind, _, text, _ in parser.blocks:
        prose = kind in ("paragraph", "list_item")
        worth = min(len(text), 500) * (len(text) >= 20) if prose else 80 * (kind == "heading" or kind in FIGURES)
        for i in chain:
            scores[i] = [scores[i][0] + worth, scores[i][1] + prose]
    for rank, method in METHODS.items():
        found = [i for i, part in enumerate(parser.parts) if part.rank == rank and part.seen]
        best = max(found, key=lambda i: scores[i], default=-1)
        if best >= 0 and scores[best][0]:
            return best, method
    return next((i for i, part in enumerate(parser.parts) if part.tag == "body" and part.seen), -1), "body_fallback"


def article(text: str | None):
    """(method, flags, meta, blocks) of a page; without blocks if it can't be parsed."""
    if (text or "").lstrip().startswith("%PDF-"):
        return "pdf_unsupported", ["pdf"], {}, []
    parser = _Blocks()
    try:
        parser.feed(text or "")
        parser.close()
    except (AssertionError, ValueError):
        return "body_fallback", [], {}, []
    body, method = _body(parser)
    inside = lambda chain: body < 0 or body in chain
    joined = lambda part: "".join(data for chain, data in parser.raw if part < 0 or part in chain)
    flags = {name for chain, name in parser.marks if inside(chain)}
    if parser.meta.get("citation_pdf_url"):
        flags.add("pdf_link")
    flags |= {"paper" for name in parser.meta if name.startswith("citation_")}
    figures = [part for part in parser.parts if part.tag == "figure" and part.seen and inside(part.chain)]
    if figures and not any(part.graphic or not part.textual for part in figures):
        flags.add("figures_told")
    if re.search(LOGIN, joined(body)):
        flags.add("login")
    if any(part.tag == "form" and re.search(LOGIN, joined(i)) for i, part in enumerate(parser.parts)):
        flags.add("login_form")
    if body >= 0 and any(parser.parts[i].tag in CLOSING and not parser.parts[i].closed for i in parser.parts[body].chain):
        flags.add("unclosed")
    return method, sorted(flags), parser.meta, [b[1:] for b in parser.blocks if inside(b[0])]


def parse(text: str | None):
    """(blocks of the article, meta)."""
    _, _, meta, blocks = article(text)
    return blocks, meta


#: Bytes of pages whose blocks a worker holds as Python objects at a time; a larger page goes alone.
PIECE = 1 << 20
BLOCKS = "kind:string,level:int,text:string,links:array<string>"


def html_articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, method, flags, meta and blocks of each page, parsed once; no blocks of a null or empty page."""
    key = pages.schema[id_col].dataType.simpleString()
    block = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("links", pa.list_(pa.string()))])
    types = [pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.list_(block)]

    def run(batches):
        for batch in by_bytes(batches, 1, PIECE):
            method, flags, meta, blocks = zip(*map(article, batch.column(1).to_pylist()), strict=True)
            columns = method, flags, [list(m.items()) for m in meta], [[dict(zip(("kind", "level", "text", "links"), b, strict=True)) for b in bs] for bs in blocks]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[id_col, "method", "flags", "meta", "blocks"])

    schema = f"{id_col} {key}, method string, flags array<string>, meta map<string,string>, blocks array<struct<{BLOCKS}>>"
    return pages.select(id_col, html_col).mapInArrow(run, schema)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, kind, level, text, links of each block of the article."""
    return html_articles(pages, id_col, html_col).select(id_col, F.posexplode("blocks").alias("pos", "_b")).select(id_col, "pos", "_b.*")


@F.pandas_udf(T.StringType())
def unescape(texts):
    return texts.map(lambda t: None if t is None else entities.unescape(t))


def clean_html(text, most: int):
    """Text without tags and entities, squeezed, most characters."""
    return F.substring(F.trim(F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]*>", " ")), r"\s+", " ")), 1, most)
