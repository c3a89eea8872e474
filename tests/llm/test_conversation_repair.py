"""Repairs of conversations against enumeration and a plain version."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from tessella.llm import conversation_repair as cr

GRAMMAR = re.compile(r"(s?(ua)+)?")
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def enumerated(initials, faults):
    """The least (cost, edits) of all edit sequences with at most two inserts between rows."""
    gaps = [x for n in range(3) for x in itertools.product([("I", "u"), ("I", "a")], repeat=n)]
    own = [[("D", "")] if f in (1, 2) else [("K", c), ("R", "u"), ("R", "a"), ("D", "")] for c, f in zip(initials, faults, strict=True)]
    best = None
    for parts in itertools.product(gaps, *(x for o in own for x in (o, gaps))):
        edits = [e for i, p in enumerate(parts) for e in (p if i % 2 == 0 else (p,))]
        if not GRAMMAR.fullmatch("".join(c or "?" if e == "K" else c for e, c in edits)):
            continue
        kept = [p[0] != "D" for p in parts[1::2]]
        cost = sum(COST[e] for e, _ in edits) + sum(3 for k, f in zip(kept, faults, strict=True) if k and f == 3)
        way = (cost, "".join(e for e, _ in edits))
        best = way if best is None or way < best else best
    return best


def plain_best(initials, faults):
    """By recursion from the end, over states of the grammar."""

    @cache
    def rest(i, q, inserts):
        to = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[q]
        ways = [(0, "")] if i == len(initials) and q in (0, 3) else []
        if inserts < 3:
            ways.append((3, "I", i, to[1], inserts + 1))
        if i < len(initials):
            ways.append((4, "D", i + 1, q, 0))
            if faults[i] not in (1, 2):
                more = 3 if faults[i] == 3 else 0
                ways.append((3 + more, "R", i + 1, to[1], 0))
                c = initials[i]
                if c == to[0] or (c == "s" and q == 0):
                    ways.append((more, "K", i + 1, 1 if c == "s" else to[1], 0))
        found = []
        for w in ways:
            if len(w) == 2:
                found.append(w)
            elif (r := rest(*w[2:])) is not None:
                found.append((w[0] + r[0], w[1] + r[1]))
        return min(found, default=None)

    return rest(0, 0, 0)


def plain_report(rows):
    """From (conv_id, turn, role, text) rows to the contract's columns."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = plain_best([r[:1] for _, r, _ in own], faults)
        lines, left, n = [], iter(own), len(audit) - audit.count("D")
        roles = iter(["s"] * (n % 2) + ["user", "assistant"] * (n // 2))
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            given = next(roles)
            lines.append(f"{row[1] if e == 'K' else given}:{row[2] if row else ''}")
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
DDL = "conv_id long, turn long, role string, text string, part int, k string"


def reported(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in NAMES) for r in rows}


def test_search_against_enumeration():
    r = random.Random(3)
    for _ in range(60):
        n = r.choice((0, 1, 2, 2))
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice((0, 0, 1, 2, 3)) for _ in range(n)]
        got = next(iter(cr.cheapest(initials, faults, 0, cr.ENDS).values()))
        assert got == enumerated(initials, faults) == plain_best(initials, faults)


def test_search_against_recursion():
    r = random.Random(4)
    for _ in range(300):
        n = r.randrange(12)
        initials, faults = [r.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(n)], [r.choice((0, 0, 0, 1, 2, 3)) for _ in range(n)]
        assert next(iter(cr.cheapest(initials, faults, 0, cr.ENDS).values())) == plain_best(initials, faults)


def odd_conversations():
    r = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why?", "Yes.", "ends so. \n", "漢字。", None, "dots... in the middle, no end", " "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "su"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(40) for t in r.sample(range(30), r.randrange(12))]
    rows += [(None, t, "user", "no id.") for t in (None, None, 1, 2, 2)]
    rows += [(99, t, r.choice(roles), r.choice(texts)) for t in [None, 5, 5, 5, *range(8, 40)] for _ in range(3)]
    rows += [(98, 1, "user", "the same row.")] * 30 + [(98, 2, "assistant", "x" * 100_000)]
    rows += [(97, -(1 << 62), "user", "far."), (97, 1 << 62, "assistant", "apart.")]
    return [(*x, 1, "clash") for x in rows]


@pytest.fixture(scope="module")
def odd_turns(spark):
    return spark.createDataFrame(odd_conversations(), DDL).repartition(5)


def test_report_of_odd_rows(odd_turns):
    assert reported(cr.repair_report(odd_turns)) == plain_report([x[:4] for x in odd_conversations()])


def test_report_of_the_table(spark, small):
    d = spark.read.parquet(f"{small}/conversations.parquet")
    want = plain_report([tuple(r) for r in d.select("conv_id", "turn", "role", "text").collect()])
    assert reported(cr.repair_report(d)) == want


@pytest.mark.parametrize("rows", [0, 5])
def test_long_conversations_in_pieces_are_the_same(odd_turns, rows):
    """Every conversation, or those over five rows, as pieces of a few rows or characters."""
    small = "spark.sql.adaptive.coalescePartitions.enabled"  # else the few rows are one partition
    odd_turns.sparkSession.conf.set(small, "false")
    try:
        found = cr.repair_conversations(cr.damage_turns(odd_turns), long_rows=rows, piece_rows=3, piece_chars=60)
    finally:
        odd_turns.sparkSession.conf.unset(small)
    assert reported(found.with_digests()) == plain_report([x[:4] for x in odd_conversations()])
    pieces = found.pieces.collect()
    assert max(len(r["turns"]) for r in pieces) <= (12 if rows else 7)  # rows and what is inserted
    assert len({r["part"] for r in pieces if r["conv_id"] == 99}) > 1  # no task had all of it


def test_rows_that_all_go_and_none(spark):
    gone = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]
    d = spark.createDataFrame([(7, t, "user", "Gone.", 1, "x") for t in gone], DDL)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert reported(cr.repair_report(d)) == {7: none}
    assert reported(cr.repair_conversations(cr.damage_turns(d), long_rows=1).with_digests()) == {7: none}
    empty = cr.repair_report(spark.createDataFrame([], DDL))
    assert empty.count() == 0 and set(NAMES) < set(empty.columns)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "cut")]
    found = cr.repair_conversations(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, copies long"))
    (report,), (piece,) = found.report.collect(), found.pieces.collect()
    assert (report["cost"], report["audit"]) == plain_best(["a", "u", "u", "a"], [0, 0, 2, 3])
    assert [(t["edit"], t["role"], t["text"]) for t in piece["turns"]] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi."), ("K", "assistant", "cut")]
