"""Threaded pages and nested payloads against plain versions over trees."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessella.plans import feeds
from tessella.sources import nested, threads

THREAD = """<!doctype html><html lang="en"><head><meta charset="utf-8" /><title>Builders</title></head><body><main>
<article class="topic-post" data-post-id="101"><header><a class="username">Alpha</a><time datetime="2026-04-02T10:00:00Z">then</time></header>
<div class="cooked"><p>Late games feel slower after the update, and fights break off.</p><p>short</p></div></article>
<article class="topic-post reply" data-post-id="102" data-reply-to-id="101"><header><a class="username">Caller</a><time title="2026-04-03T13:30:00+02:00"></time></header>
<div class="cooked"><p>Both show the same pattern now: makers want a faster pace.</p></div></article>
<div id="post-103" class="comment"><span class="poster">Alpha</span> at 2026-04-05T01:02:03Z said <a href="#post-102">this</a> without a paragraph</div>
<article class="topic-post" data-post-id="102"><p>The same number again, which is not counted.</p></article>
<section class="message"><p>tiny</p></section></main></body></html>"""


def test_a_thread():
    rows = threads.posts(THREAD, "https://f.example/t/1", "2026-04-09T12:00:00Z")
    assert [(r[0], r[1], r[2], r[4]) for r in rows] == [(0, "post", "101", "Alpha"), (1, "post", "102", "Caller"), (2, "post", "103", "Alpha")]
    assert rows[0][5] == "Late games feel slower after the update, and fights break off."
    assert [r[6] for r in rows] == ["2026-04-02T10:00:00Z", "2026-04-03T11:30:00Z", "2026-04-05T01:02:03Z"]
    assert [r[7] for r in rows] == [None, "101", "102"] and [r[8] for r in rows] == [None, rows[0][3], rows[1][3]]
    assert rows[0][3] == rows[2][3] != rows[1][3]


def test_windows():
    at = lambda since, until: [r[2] for r in threads.posts(THREAD, "u", "2026-04-09T12:00:00Z", since, until)]
    assert at("2026-04-03T00:00:00Z", None) == ["102", "103"] and at(None, "2026-04-03T00:00:00+00:00") == ["101"]
    assert at("2027-01-01T00:00:00Z", None) == ["101", "102", "103"]  # none within: all


def test_pages_without_posts():
    html = "<main><p>A paragraph that is long enough to stand for a page.</p><p>short</p><ul><li>An entry that is long enough, too, to be counted.</li></ul></main>"
    rows = threads.posts(html, "https://f.example/x", "2026-04-09T12:00:00Z")
    assert [(r[1], r[4], r[6]) for r in rows] == [("paragraph", "site-author", "2026-04-09T12:00:00Z")] * 2
    assert len({r[2] for r in rows}) == 2 and threads.posts("", "", "now") == [] and threads.posts("<p", "", "now") == []


def test_deep_pages():
    assert len(threads.posts("<div>" * 20_000 + "<li class=post>" + "word " * 10, "u", "now")) == 1


class Tree(HTMLParser):
    """A page as nested dicts."""

    def __init__(self, html):
        super().__init__()
        self.root = {"tag": "document", "a": {}, "in": [], "own": []}
        self.stack = [self.root]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        if tag != "meta":
            self.stack[-1]["in"].append({"tag": tag, "a": {k.lower(): v or "" for k, v in attrs}, "in": [], "own": []})
            self.stack.append(self.stack[-1]["in"][-1])

    def handle_endtag(self, tag):
        if len(self.stack) > 1:
            self.stack.pop()

    def handle_data(self, data):
        if data.split():
            self.stack[-1]["own"].append(" ".join(data.split()))


def text(node):
    return " ".join([*node["own"], *(t for x in node["in"] if (t := text(x)))]).strip()


def below(node):
    for x in node["in"]:
        yield x
        yield from below(x)


def plain_bodies(html):
    """(number of the element, id, body) of the posts, or the paragraphs."""
    root, out, seen = Tree(html).root, [], set()
    for n, x in enumerate(below(root)):
        marks = " ".join(x["a"].values()).lower()
        if x["tag"] in ("article", "div", "section", "li") and (any(m in marks for m in ("comment", "reply", "post", "message", "discussion", "forum")) or {"data-post-id", "data-comment-id", "data-reply-to-id"} & set(x["a"])):
            body = "\n\n".join(t for y in below(x) if y["tag"] in ("p", "blockquote", "li") and len(t := text(y)) >= 20) or text(x)
            own = next((v.replace("post-", "") for k in ("data-post-id", "data-comment-id", "data-id", "id") if (v := x["a"].get(k))), body)
            if len(body) >= 24 and own not in seen:
                seen.add(own)
                out.append(body)
    return out or [text(x) for x in below(root) if x["tag"] in ("p", "li") and len(text(x)) >= 40]


def test_random_pages_against_trees():
    r = random.Random(1)
    tags = ["div", "p", "li", "article", "section", "span", "blockquote", "br", "meta"]
    kinds = ["", ' class="post"', ' class="comment user"', ' id="post-7"', ' data-post-id="3"', ' href="#post-3"', ' class="x"']
    for _ in range(200):
        html = "".join(r.choice([f"<{r.choice(tags)}{r.choice(kinds)}>", f"</{r.choice(tags)}>", "some words of a text ", "more & yet more words here "]) for _ in range(r.randrange(40)))
        assert [x[5] for x in threads.posts(html, "u", "now")] == plain_bodies(html)


def test_page_threads_against_trees(spark, small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {}
    for r in sorted(feeds.page_threads(spark, small).collect(), key=lambda r: r["position"]):
        got.setdefault(r["page_id"], []).append(r["body"])
    assert got == {k: b for k, h in pages.items() if (b := plain_bodies(h))}


def test_reply_links(spark):
    page = spark.createDataFrame([(1, "https://f.example/t", THREAD), (2, None, None)], "page_id int, url string, html string")
    found = threads.page_posts(page, F.lit("2026-04-09T12:00:00Z"))
    assert found.count() == 3
    assert sorted((r["message_id"], r["parent_id"]) for r in threads.reply_links(found).collect()) == [("102", "101"), ("103", "102")]


PAYLOADS = [
    '{"b": ["x", {"z": "deep", "a": [[], [["deeper"]], 5]}], "a": "first", "c": null, "d": true, "e": 1.5}', '"alone"', "[]", "{}", "null", "12", "not json", None,
    '{"t": "{\\"no\\": \\"object\\"}", "é": "ü\\n"}', json.dumps({"k": [str(i) for i in range(12)]}), json.dumps([[[[[["six"]]]]]]), '{"": "no name", "x": ["", " "]}',
]


def plain_strings(x):
    if isinstance(x, str):
        return [x]
    return [s for v in ([x[k] for k in sorted(x)] if isinstance(x, dict) else x if isinstance(x, list) else []) for s in plain_strings(v)]


def plain_texts(x):
    if x is None:
        return []
    if isinstance(x, dict):
        return [s for k in sorted(x) for s in (k, *plain_texts(x[k]))]
    if isinstance(x, list):
        return [s for v in x for s in plain_texts(v)]
    return ["true" if x is True else "false" if x is False else str(x)]


@pytest.mark.parametrize("kind", ["text", "variant"])
def test_leaves(spark, kind):
    d = spark.createDataFrame(list(enumerate(PAYLOADS)), "i int, p string")
    payload = F.col("p") if kind == "text" else F.try_parse_json("p")
    loaded = {}
    for i, p in enumerate(PAYLOADS):
        try:
            loaded[i] = json.loads(p) if p is not None else None
        except ValueError:
            loaded[i] = None
    for f, plain in ((nested.string_values, plain_strings), (nested.flat_texts, plain_texts)):
        got = {}
        for r in sorted(f(d, ["i"], payload).collect(), key=lambda r: r["position"]):
            got.setdefault(r["i"], []).append(r["value"])
        assert got == {i: s for i, x in loaded.items() if (s := plain(x))}, f


def test_more_leaves_than_a_recursive_query_may_have(spark):
    d = spark.range(3).select("id", F.to_json(F.array_repeat(F.lit("x"), 2000)).alias("p"))
    spark.conf.set(nested.ROW_LIMIT, "1000")
    try:
        assert nested.string_values(d, ["id"], F.col("p")).count() == 6000
        assert spark.conf.get(nested.ROW_LIMIT) == "1000"
    finally:
        spark.conf.unset(nested.ROW_LIMIT)
