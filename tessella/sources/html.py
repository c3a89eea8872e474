"""Messages of web pages. Parsing is sequential within a page, so it runs in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id

LEAST_PARAGRAPH = 40
_SKIPPED, _BLOCKS = {"script", "style", "noscript", "template"}, {"p", "li"}
MESSAGE = "page_id bigint, url string, kind string, number int, author string, created_at string, parent int, body string"


class _Page(HTMLParser):
    """Title, description, paragraphs and JSON-LD blocks; an unclosed block ends where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.paragraphs, self.data, self.scripts = "", {}, [], [], 0
        self._open: list[str] = []
        self._text: list[str] | None = None

    def _close(self) -> None:
        if self._text is not None:
            body = " ".join("".join(self._text).split())
            if len(body) >= LEAST_PARAGRAPH:
                self.paragraphs.append(body)
        self._text = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIPPED:
            self.scripts += tag == "script"
            self._open.append("ld" if tag == "script" and "ld+json" in (a.get("type") or "") else tag)
            if self._open[-1] == "ld":
                self.data.append("")
        elif tag in _BLOCKS:
            self._close()
            self._text = []
        elif tag == "title":
            self._open.append(tag)
        elif tag == "meta" and a.get("name"):
            self.meta[a["name"].lower()] = a.get("content") or ""

    def handle_endtag(self, tag):
        if tag in _BLOCKS or tag in ("ul", "ol", "div", "body", "article", "section"):
            self._close()
        elif self._open and (self._open[-1] == tag or self._open[-1] == "ld" and tag == "script"):
            self._open.pop()

    def handle_data(self, data):
        top = self._open[-1] if self._open else ""
        if top == "ld":
            self.data[-1] += data
        elif top == "title":
            self.title += data
        elif top not in _SKIPPED and self._text is not None:
            self._text.append(data)

    def close(self):
        super().close()
        self._close()


def _comments(node, parent, out) -> None:
    """The tree of a JSON-LD discussion, depth first, children knowing their parent's number."""
    if isinstance(node, list):
        for x in node:
            _comments(x, parent, out)
        return
    if not isinstance(node, dict):
        return
    body = node.get("articleBody") or node.get("text") or node.get("description")
    author = node.get("author")
    if body:
        out.append(("comment", author.get("name") if isinstance(author, dict) else author, node.get("dateCreated") or node.get("datePublished"), parent, " ".join(str(body).split())))
        parent = len(out) - 1
    for k in ("@graph", "mainEntity", "comment"):
        if k in node:
            _comments(node[k], parent, out)


def parse(text: str) -> list[tuple]:
    """(kind, author, created_at, parent, body) of a page: a forum topic's posts if it is one in
    JSON, else a JSON-LD discussion, else its paragraphs."""
    if text.lstrip()[:1] == "{":
        try:
            posts = json.loads(text)["post_stream"]["posts"]
            at = {p.get("post_number"): i for i, p in enumerate(posts)}
            strip = lambda h: " ".join(re.sub(r"<[^>]*>", " ", h or "").split())
            return [("post", p.get("username"), p.get("created_at"), at.get(p.get("reply_to_post_number")), strip(p.get("cooked"))) for p in posts]
        except (ValueError, KeyError, TypeError):
            pass
    page = _Page()
    page.feed(text)
    page.close()
    out: list[tuple] = []
    for block in page.data:
        try:
            _comments(json.loads(block), None, out)
        except ValueError:
            continue
    if not out:
        author = page.meta.get("author")
        out = [("paragraph", author, None, None, p) for p in page.paragraphs]
    return out


def page_messages(pages: DataFrame) -> DataFrame:
    """A row for each message of (page_id, url, html), with a stable message_id; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                rows += [(page_id, url, kind, i, author, at, parent, body) for i, (kind, author, at, parent, body) in enumerate(parse(html or ""))]
            names = [x.split()[0] for x in MESSAGE.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    d = pages.select("page_id", "url", "html").mapInArrow(run, MESSAGE)
    return d.withColumn("message_id", stable_id(F.col("url"), F.col("number").cast("string")))
