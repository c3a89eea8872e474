"""Posts of threaded pages, by a table function that is joined to pages laterally.

A page is read into its elements in document order, each with the end of its subtree, so that what is
inside an element is a slice. An end tag closes the innermost open element, whatever its name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# What marks a post, an author and a time, and the least lengths.
CONTAINERS = ("article", "div", "section", "li")
POST_MARKS = ("comment", "reply", "post", "message", "topic-post", "discussion", "forum")
POST_KEYS = ("data-post-id", "data-comment-id", "data-reply-to-id")
AUTHOR_MARKS = ("author", "username", "user", "poster", "display-name")
TIME_KEYS = ("data-time", "data-created-at", "datetime")
REPLY_KEYS = ("data-reply-to-id", "data-reply-to-post-number")
ID_KEYS = ("data-post-id", "data-comment-id", "data-id", "id")
BODY_TAGS, PARAGRAPH_TAGS = ("p", "blockquote", "li"), ("p", "li")
LEAST_PART, LEAST_BODY, LEAST_PARAGRAPH = 20, 24, 40
TIME = re.compile(r"20\d{2}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})")

POST = "position int, kind string, message_id string, author_id string, author_name string, body string, created_at string, reply_to_message_id string, reply_to_user_id string"


class _Elements(HTMLParser):
    """tags, attributes, parents, own words and subtree ends, in document order; 0 is the document."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.tags, self.attributes, self.parents, self.words, self.ends = ["document"], [{}], [-1], [[]], [0]
        self._open = [0]
        self.feed(html)
        n = len(self.tags)
        for i in self._open:
            self.ends[i] = n
        # the words of an element come before those of what is in it
        inside: list[list[str]] = [[] for _ in range(n)]
        self.texts = [""] * n
        for i in range(n - 1, -1, -1):
            self.texts[i] = " ".join([*self.words[i], *reversed(inside[i])])
            if i and self.texts[i]:
                inside[self.parents[i]].append(self.texts[i])

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            return
        self.tags.append(tag)
        self.attributes.append({k.lower(): v or "" for k, v in attrs})
        self.parents.append(self._open[-1])
        self.words.append([])
        self.ends.append(0)
        self._open.append(len(self.tags) - 1)

    def handle_endtag(self, tag):
        if len(self._open) > 1:
            self.ends[self._open.pop()] = len(self.tags)

    def handle_data(self, data):
        if own := " ".join(data.split()):
            self.words[self._open[-1]].append(own)

    def inner(self, i: int) -> range:
        return range(i + 1, self.ends[i])


def _id(*parts: str) -> str:
    return hashlib.sha256("::".join(parts).encode("utf-8", "replace")).hexdigest()[:16]


def iso_utc(value: str | None, otherwise: str) -> str:
    """To the second, in UTC with a Z; what can't be read is ``otherwise``."""
    try:
        at = datetime.fromisoformat((value or "").strip().replace("Z", "+00:00"))
    except ValueError:
        return otherwise
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return at.astimezone(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")


def _first(values: Iterator[str | None]) -> str | None:
    return next((v for v in values if v), None)


def _author(page: _Elements, i: int) -> str | None:
    def name(k: int) -> str | None:
        a = page.attributes[k]
        marked = any(m in " ".join(a.values()).lower() for m in AUTHOR_MARKS) or a.get("rel") == "author"
        return page.texts[k].strip() if marked else None

    return _first(name(k) for k in page.inner(i))


def _time(page: _Elements, i: int) -> str | None:
    for k in page.inner(i):
        a = page.attributes[k]
        if page.tags[k] == "time":
            return a.get("datetime") or a.get("title") or page.texts[k]
        if found := _first(a.get(x) for x in TIME_KEYS):
            return found
    found = TIME.search(page.texts[i])
    return found[0] if found else None


def _reply_to(page: _Elements, i: int) -> str | None:
    own = _first(page.attributes[i].get(x) for x in REPLY_KEYS)
    anchor = (h.rsplit("#", 1)[-1] for k in page.inner(i) if "#" in (h := page.attributes[k].get("href", "")))
    return own or ((a := _first(anchor)) and a.replace("post-", ""))


def posts(html: str, url: str, observed_at: str, since: str | None = None, until: str | None = None) -> list[tuple]:
    """Rows of ``POST``: the posts of a page in document order, each id once, those within the window or,
    if none is, all; on a page without posts its longer paragraphs."""
    page, host, out, author_of = _Elements(html), urlparse(url).netloc, [], {}
    for i in page.inner(0):
        a = page.attributes[i]
        if page.tags[i] not in CONTAINERS or not (any(m in " ".join(a.values()).lower() for m in POST_MARKS) or any(k in a for k in POST_KEYS)):
            continue
        parts = [t for k in page.inner(i) if page.tags[k] in BODY_TAGS and len(t := page.texts[k].strip()) >= LEAST_PART]
        body = "\n\n".join(parts) or page.texts[i].strip()
        if len(body) < LEAST_BODY:
            continue
        own = _first(a.get(k) for k in ID_KEYS)
        message = own.replace("post-", "") if own else f"web-message-{_id(url, body)}"
        if message in author_of:
            continue
        name = _author(page, i) or "unknown"
        answered = _reply_to(page, i)
        out.append(("post", message, f"web-user-{_id(host, name)}", name, body, iso_utc(_time(page, i), observed_at), answered, author_of.get(answered)))
        author_of[message] = out[-1][2]
    inside = [r for r in out if (since is None or _at(r[5]) >= _at(since)) and (until is None or _at(r[5]) <= _at(until))]
    rows = inside or out
    if not rows:
        writer = f"web-user-{_id(host or 'web', 'site-author')}"
        longer = ((n, page.texts[i].strip()) for n, i in enumerate(page.inner(0)) if page.tags[i] in PARAGRAPH_TAGS)
        rows = [("paragraph", f"web-message-{_id(url, str(n), t)}", writer, "site-author", t, observed_at, None, None) for n, t in longer if len(t) >= LEAST_PARAGRAPH]
    return [(n, *r) for n, r in enumerate(rows)]


def _at(value: str) -> datetime:
    at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


@udtf(returnType=POST, useArrow=True)
class PagePosts:
    def eval(self, html: str, url: str, observed_at: str, since: str, until: str):
        yield from posts(html or "", url or "", observed_at, since, until)


def page_posts(pages: DataFrame, observed_at: Column, since: str | None = None, until: str | None = None) -> DataFrame:
    """page_id, url and the rows of :func:`posts` for each page; pages without any have none."""
    p = pages.select("page_id", "url", "html", observed_at.alias("observed_at"))
    own = [F.col(c).outer() for c in ("html", "url", "observed_at")]
    window = [F.lit(x).cast("string") for x in (since, until)]
    return p.lateralJoin(PagePosts(*own, *window)).drop("html", "observed_at")


def reply_links(found: DataFrame) -> DataFrame:
    """(page_id, message_id, source_user_id, target_user_id, parent_id) of posts that answer another."""
    answered = found.where("reply_to_message_id is not null and (reply_to_user_id is null or reply_to_user_id <> author_id)")
    return answered.select("page_id", "message_id", F.col("author_id").alias("source_user_id"), F.col("reply_to_user_id").alias("target_user_id"), F.col("reply_to_message_id").alias("parent_id"))
