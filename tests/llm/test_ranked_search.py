"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from odd_rows import ODD
from tessella.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=rs.TOP):
    """Sorted (item_id, rank, score, doc_id) lists of every item of (id, text)."""
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, -s, None if none else i) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["score"], r["doc_id"]) for r in df.collect()), key=str)


ITEMS = [
    (1, "the same TEXT twice twice over"), (2, None), (3, " !?"), (4, "l1 l2 café 漢字かな x"), (5, "abcd efgh ab abc bcd a bb cc dd gh " * 3), (None, "tiny negative id"),
    (1, "another text of item one, over"), (7, "no such term as zzzzzz"), (8, "A\x00b"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*x, 1, "s") for x in ITEMS], "item_id long, text string, doc_id int, score string").repartition(2)


def test_odd_rows(odd, items):
    assert found(rs.ranked_search(odd, items)) == plain_search([(i, t) for i, t, _ in ODD], ITEMS)
    assert found(rs.ranked_search(odd, items, k=2)) == plain_search([(i, t) for i, t, _ in ODD], ITEMS, 2)


def test_empty_tables(none, odd, items):
    for got in (rs.ranked_search(none, items), rs.ranked_search(odd, items.limit(0))):
        assert got.count() == 0 and set(got.columns) == {"item_id", "rank", "doc_id", "score"}


def test_the_table(spark, docs, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(rs.ranked_search(docs, items)) == want


def test_items_in_blocks_are_the_same(odd, items, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_ITEMS", 2)
    assert found(rs.ranked_search(odd, items)) == plain_search([(i, t) for i, t, _ in ODD], ITEMS)


def shard_of(docs, vocabulary):
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = [sorted((number[t], n) for t, n in Counter(d).items()) for d in docs]
    at = np.r_[0, np.cumsum([len(r) for r in rows])]
    term, tf = np.array([p for r in rows for p in r], np.int64).T
    df = np.bincount(term, minlength=len(number))
    lengths = np.array([len(d) for d in docs])
    weight = rs.weights(len(docs), df)
    return rs.Shard(at, term, tf, rs.length_norms(lengths, len(docs), int(lengths.sum())), weight), number


def test_the_reading_stops_at_the_threshold_and_loses_nothing():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    docs = [r.choices(words, [1 / (i + 1) for i in range(300)], k=r.randrange(5, 60)) for _ in range(6000)] + [words[200:230]] * 30
    shard, number = shard_of(docs, words)
    for query in (words[200:230], words[:3] * 2 + ["w250"], r.sample(words, 12)):
        times = Counter(number[t] for t in query)
        q, n = np.array(sorted(times)), np.array([times[i] for i in sorted(times)])
        best, read = [], {}
        shard.search(q, n, best, 20, lambda i: (-i,), read)
        shard.times[q] = n
        scores = shard.scores(np.flatnonzero(np.diff(shard.at)))
        shard.times[q] = 0
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:20]
        assert sorted(best, reverse=True) == want
        assert not shard.times.any()
    best, read = [], {}
    shard.search(np.arange(200, 230), np.ones(30, np.int64), best, 20, lambda i: (-i,), read)
    assert read["documents"] < 2500  # 30 documents hold all the terms


def test_large_counts_do_not_overflow():
    n = np.array([1, 1 << 40])
    assert rs.length_norms(n, 1 << 33, 1 << 60).tolist() == [75 + 25 * int(x) * (1 << 33) // (1 << 60) for x in n]
