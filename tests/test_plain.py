"""Queries that have no SQL twin, against plain versions over the small tables."""

import math
from collections import Counter, defaultdict

import pandas as pd
import pytest

from tessella import registry
from tessella.functions import scalars


def rows(spark, small, name):
    return [r.asDict(recursive=True) for r in registry.queries()[name](spark, small).collect()]


def table(small, name):
    return pd.read_parquet(f"{small}/{name}.parquet")


def plain_users(small):
    """Each tenant's users with what they did, their mean session and their commonest event."""
    source = {"click": "ga4", "view": "ga4", "signup": "hubspot", "purchase": "hubspot"}
    users = defaultdict(lambda: {"behaviors": set(), "pages": set(), "durations": [], "events": Counter()})
    for e in table(small, "events").sort_values("event_id").itertuples():
        k = "".join(c for c in e.props if c.isdigit())
        u = users[e.user_id % 4, e.user_id]
        u["behaviors"] |= {e.event_type, f"{e.event_type}_{int(k) % 8}"}
        u["pages"].add(f"/k/{k}")
        u["events"][e.event_type] += 1
        if source.get(e.event_type) == "ga4":
            u["durations"].append(e.value)
    return users


def greedy(users, size, start, add, similarity, threshold):
    """Groups of two or more, tenant by tenant, users of many features first."""
    found = set()
    for tenant in range(4):
        clusters = []
        for key in sorted((k for k in users if k[0] == tenant), key=lambda k: (-size(users[k]), k[1])):
            u = users[key]
            scored = [similarity(u, c, tenant) for c, _ in clusters]
            best = max(range(len(scored)), key=lambda i: (scored[i], -i), default=None)
            if best is None or scored[best] < threshold or scored[best] <= 0:
                clusters.append((start(u), [key[1]]))
            else:
                add(u, clusters[best][0])
                clusters[best][1].append(key[1])
        found |= {(f"t{tenant}", ",".join(sorted(map(str, m)))) for _, m in clusters if len(m) > 1}
    return found


def test_jaccard_segments(spark, small):
    def similarity(u, c, _):
        return len(u["behaviors"] & c) / len(u["behaviors"] | c)

    want = greedy(plain_users(small), lambda u: len(u["behaviors"]), lambda u: set(u["behaviors"]), lambda u, c: c.update(u["behaviors"]), similarity, 0.6)
    assert {(r["tenant_id"], r["members"]) for r in rows(spark, small, "segment_jaccard")} == want and want


def test_gower_segments(spark, small):
    users = plain_users(small)
    mean = {k: sum(u["durations"]) / len(u["durations"]) for k, u in users.items() if u["durations"]}
    spread = {t: max(v) - min(v) for t in range(4) if (v := [x for k, x in mean.items() if k[0] == t])}
    for k, u in users.items():
        u["n"], u["event"] = mean.get(k), u["events"].most_common(1)[0][0]

    def start(u):
        c = {"b": set(), "p": set(), "n": [], "e": Counter()}
        add(u, c)
        return c

    def add(u, c):
        c["b"] |= u["behaviors"]
        c["p"] |= u["pages"]
        c["n"] += [u["n"]] if u["n"] is not None else []
        c["e"][u["event"]] += 1

    def similarity(u, c, tenant):
        far = [1 - len(x & y) / len(x | y) for x, y in ((u["behaviors"], c["b"]), (u["pages"], c["p"]))]
        far = [x for x in far if x > 0]  # the event is always there
        if u["n"] is not None and c["n"]:
            far.append(min(abs(u["n"] - sum(c["n"]) / len(c["n"])) / spread[tenant], 1.0) if spread[tenant] else 0.0)
        far.append(float(c["e"].most_common(1)[0][0] != u["event"]))
        return 1 - sum(far) / len(far)

    want = greedy(users, lambda u: len(u["behaviors"]) + (u["n"] is not None) + 1, start, add, similarity, 0.15)
    assert {(r["tenant_id"], r["members"]) for r in rows(spark, small, "segment_gower")} == want and want


def plain_style(text):
    import re

    n, words = max(1, len(text)), text.split()
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    count = lambda xs: sum(text.count(x) for x in xs)
    wc, k = max(1, len(words)), max(1, len(parts))
    return (
        min(len(text) / 2000, 1.0), min(sum(map(len, words)) / wc / 10, 1.0), min(count(".,;:!?-—–()[]{}\"'`") / n * 5, 1.0), min(count("'’") / wc * 3, 1.0),
        sum(1 for f in parts if f and f[-1] not in ".!?") / k, min(sum(ord(c) > 127 for c in text) / n * 10, 1.0), sum(1 for f in parts if f and f[0].isupper()) / k, min(len(words) / 200, 1.0),
    )


def test_style_coherent_samples(spark, small):
    got = defaultdict(set)
    for r in rows(spark, small, "style_coherent_samples"):
        got[r["conv_id"]].add(r["turn"])
    for conv, g in table(small, "conversations").groupby("conv_id"):
        style = {r.turn: plain_style(r.text) for r in g.itertuples()}
        mean = {t: sum(math.dist(style[t], style[o]) for o in style if o != t) / max(1, len(style) - 1) for t in style}
        assert got[conv] == set(sorted(style, key=lambda t: (round(mean[t], 9), t))[:4])


@pytest.fixture(scope="module")
def turns(spark, small):
    c = spark.read.parquet(f"{small}/conversations.parquet")
    out = defaultdict(list)
    for r in c.select("conv_id", "turn", "role", "text", scalars.embed(c["text"]).alias("v")).orderBy("conv_id", "turn").collect():
        out[r["conv_id"]].append(r)
    return out


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b) + 1e-10)


def test_grounded_claims(spark, small, turns):
    for r in rows(spark, small, "grounded_claims"):
        t = turns[r["persona_id"]]
        said, asked = ([x["v"] for x in t if x["role"] == role] for role in ("assistant", "user"))
        score = sum(max((cosine(v, w) for w in asked), default=0.0) >= 0.2 for v in said) / len(said)
        assert (r["claims"], r["score_e6"], r["passed"]) == (len(said), round(score * 1e6), score >= 0.5)


def test_answer_shift(spark, small, turns):
    got = {r["persona_id"]: r for r in rows(spark, small, "answer_shift")}
    for conv, t in turns.items():
        pairs = [(a["v"], b["v"]) for a, b in zip(t, t[1:], strict=False) if b["turn"] == a["turn"] + 1]
        if pairs:
            rate = sum(cosine(a, b) < 0.35 for a, b in pairs) / len(pairs)
            assert (got[conv]["rate_e6"], got[conv]["passed"]) == (round(rate * 1e6), rate < 0.3)


def test_behavioral_suite(spark, small, turns):
    got = {r["dimension_id"]: (r["n"], r["passed"], r["skipped"]) for r in rows(spark, small, "suite_behavioral")}
    n = len(turns)
    stable = {}
    for conv, t in turns.items():
        means = []
        for role in {x["role"] for x in t}:
            v = [x["v"] for x in t if x["role"] == role]
            pairs = [cosine(v[i], v[j]) for i in range(len(v)) for j in range(i)]
            if pairs:
                means.append(sum(pairs) / len(pairs))
        if means:
            stable[conv] = sum(means) / len(means) >= 0.5
    assert got["D27"] == (n, sum(stable.values()) + n - len(stable), n - len(stable))
    recovered = {}
    for conv, t in turns.items():
        base, after = [x["v"] for x in t if x["turn"] < 2], [x["v"] for x in t if x["turn"] > 3]
        if base and after:
            recovered[conv] = cosine([sum(x) / len(base) for x in zip(*base, strict=True)], [sum(x) / len(after) for x in zip(*after, strict=True)]) >= 0.5
    assert got["D31"] == (n, sum(recovered.values()) + n - len(recovered), n - len(recovered))
    speaks = sum(any(x["role"] == "assistant" for x in t) for t in turns.values())
    assert all(got[d][0] == n and got[d][2] == n - speaks for d in ("D9", "D25", "D30"))


def test_html_messages(spark, tmp_path):
    from tessella.sources import html

    ld = '<script type="application/ld+json">{"@type": "DiscussionForumPosting", "headline": "Title", "text": "First post", "author": {"name": "Ann"}, "comment": [{"@type": "Comment", "text": "An answer", "author": {"name": "Bob"}}]}</script>'
    long_ = "Only <b>text</b> of the length that a paragraph must have to count as one, in markup"
    topic = '{"post_stream": {"posts": [{"post_number": 1, "username": "a", "created_at": "t", "cooked": "<p>Hello <i>all</i></p>"}, {"post_number": 2, "username": "b", "reply_to_post_number": 1, "cooked": "<p>Hi</p>"}]}}'
    pages = [(1, "https://x.org/t/1", f"<html><head>{ld}</head><body><p>seen</p></body></html>"), (2, "https://x.org/a", f"<title>Plain</title><p>{long_}</p><p>short</p>"), (3, "https://x.org/b", ""), (4, "https://x.org/c", topic), (5, "u", None)]
    got = html.page_messages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {(r["page_id"], r["number"], r["author"], r["parent"], r["body"]) for r in got} == {
        (1, 0, "Ann", None, "First post"), (1, 1, "Bob", 0, "An answer"), (2, 0, None, None, "Only text of the length that a paragraph must have to count as one, in markup"),
        (4, 0, "a", None, "Hello all"), (4, 1, "b", 0, "Hi"),
    }
    assert len({r["message_id"] for r in got}) == 5


def test_bronze_flat_records(spark):
    from tessella.operators import bronze

    b = [
        ("message", "forum", "run1", "m1", "T 1", "c1", "u1", "See https://x.org about ai tools", "2024-01-01T00:00:00Z", None),
        ("message", "forum", "run1", "m2", "T 1", "c1", "u2", "plain", "2024-01-01T00:00:01Z", "m1"), ("community", "forum", "run1", None, None, "c1", None, None, None, None),
    ]
    d = bronze.widen(spark.createDataFrame(b, "record_type string, platform string, crawl_run_id string, message_id string, thread_id string, community_id string, author_platform_user_id string, body string, created_at string, reply_to_message_id string"))
    got = {r["record_id"]: r for r in bronze.flat_records(d, "t1").collect()}
    assert sorted(got) == ["forum:message:run1:m1", "forum:message:run1:m2"]
    one, two = got["forum:message:run1:m1"], got["forum:message:run1:m2"]
    assert one["behaviors"] == ["posted", "shared_link", "topic_ai"] and two["behaviors"] == ["replied"]
    assert (one["user_id"], one["pages"], one["timestamp"], one["payload"]["text"]) == ("u1", ["/c1/t-1"], "2024-01-01T00:00:00Z", "See https://x.org about ai tools")
