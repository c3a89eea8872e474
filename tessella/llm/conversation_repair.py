"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation's rows are read in order of turn (nulls first; rows of one turn by role and text).
Each row has at most one fault: blank, duplicate (role and text seen earlier) or truncated (no full
stop, exclamation or question mark at the end). Edits are K(eep), R(erole), D(elete) and I(nsert);
the roles that remain must begin with an optional system row and then alternate user, assistant.

The search is A* on the edit lattice, whose nodes are (rows read, state of the grammar). What the
rows ahead cost at least (suffix sums of mandatory deletions and of truncation charges that no edit
avoids) is the heuristic; nodes are taken by (cost plus heuristic, edits so far), so the first goal
taken is the cheapest and, of the cheapest, the least in ASCII. Two ways to one node at one cost
have equally many letters I and none is a prefix of the other, so an order between them lasts: the
best ways through pieces of a conversation can be joined.

A short conversation is repaired where its rows meet, after one shuffle. A long one (``LONG_ROWS``,
``LONG_CHARS``) may hold any share of all rows and never meets in one task: its copies are counted
first, its rows are dealt out by ranges and cut into pieces, A* finds the best way through each
piece between each two states, and a fold over the pieces picks one way for each. Only what is one
string by definition (the edits of a conversation, the digest of its text) passes one task, the text
as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A conversation of more rows or characters than these is cut into pieces.
LONG_ROWS, LONG_CHARS = 1000, 1 << 22
#: Rows and characters of a piece (a longer text is a piece of its own).
PIECE_ROWS, PIECE_CHARS = 500, 1 << 20

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED_CHARGE = 3
FAULTS = ("", "blank", "duplicate", "truncated")
#: The grammar: 0 nothing yet, 1 after a system row, 2 after a user's, 3 after an assistant's.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that rerole and insert give in each state, and where it leads.
GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
STATES, ENDS = (0, 1, 2, 3), (0, 3)
LEGAL = ("su", "ua", "au")
_BLANKS = " \t\n\x0b\x0c\r"

Row = tuple[object, str, str, int]  # turn, role, text, fault
#: Counts of a conversation, its cost and edits: the report.
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
TURNS = "turns array<struct<edit:string,role:string,text:string>>"


def cheapest(initials: list[str], faults: list[int], start: int, ends: tuple[int, ...], each: bool = False) -> dict[int, tuple[int, str]]:
    """A* from a state of the grammar before the first row: (cost, edits) of the best way to the first
    of the end states, or to ``each`` of them."""
    n = len(initials)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, DELETE, DELETE, TRUNCATED_CHARGE)[faults[i]]
    heap, done, found = [(ahead[0], "", 0, start)], set(), {}
    while heap:
        f, edits, i, q = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and q in ends:
            found[q] = (f, edits)
            if not each or len(found) == len(ends):
                break
        cost, to = f - ahead[i], GIVEN[q][1]
        if (i, to) not in done:
            heapq.heappush(heap, (f + INSERT, edits + "I", i, to))
        if i == n:
            continue
        rest = cost + ahead[i + 1]
        heapq.heappush(heap, (rest + DELETE, edits + "D", i + 1, q))
        if faults[i] in (0, 3):
            rest += TRUNCATED_CHARGE if faults[i] else 0
            heapq.heappush(heap, (rest + REROLE, edits + "R", i + 1, to))
            if (kept := STEP.get((q, initials[i]))) is not None:
                heapq.heappush(heap, (rest + KEEP, edits + "K", i + 1, kept))
    return found


def apply_edits(rows: list[Row], edits: str, state: int = 0) -> list[dict]:
    """The repaired rows: edit, role and text of each that stays or is inserted."""
    out, left = [], iter(rows)
    for e in edits:
        if e == "I":
            role, text = GIVEN[state][0], ""
        else:
            _, role, text, _ = next(left)
            if e == "D":
                continue
            role = GIVEN[state][0] if e == "R" else role
        out.append({"edit": e, "role": role, "text": text})
        state = STEP[state, role[:1]]
    return out


def _gaps(low, high, distinct: int) -> int:
    return min(high - low + 1 - distinct, (1 << 63) - 1) if distinct else 0


def repair(rows: list[Row]) -> tuple[dict, list[dict]]:
    """Report and repaired rows of one conversation, its rows in order."""
    initials, faults = [r[1][:1] for r in rows], [r[3] for r in rows]
    turns = {t for t, *_ in rows if t is not None}
    cost, audit = next(iter(cheapest(initials, faults, 0, ENDS).values()))
    report = {"gaps": _gaps(min(turns), max(turns), len(turns)) if turns else 0}
    report |= {name: faults.count(i) for i, name in enumerate(FAULTS) if name}
    report |= {"illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit}
    return report, apply_edits(rows, audit)


def damage_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32 of ``conv_id:turn`` modulo 20. 0 drops
    the row (no copies), 1 empties its text, 2 takes full stops, exclamation and question marks out of
    it, 3 repeats it, 4 makes its role user. Nulls of role, text and in the key are one blank."""
    c = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    return c.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _fault() -> Column:
    """1 for a blank text, 3 for a truncated one, else 0."""
    ended = F.rtrim("text", F.lit(_BLANKS))
    return F.when(ended == "", 1).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3).alias("fault")


@dataclass
class Repairs:
    """``report``: a row for each conv_id with the counts, cost and edits. ``pieces``: conv_id, part, seq
    and the repaired ``turns``; a conversation's pieces come in order of part and seq."""

    short: DataFrame
    long_report: DataFrame | None = None
    long_pieces: DataFrame | None = None

    @property
    def report(self) -> DataFrame:
        a = self.short.drop("turns")
        return a if self.long_report is None else a.unionByName(self.long_report)

    @property
    def pieces(self) -> DataFrame:
        a = self.short.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("seq"), "turns")
        return a if self.long_pieces is None else a.unionByName(self.long_pieces)

    def with_digests(self) -> DataFrame:
        """The report with the SHA-256 of the repaired ``role:text`` lines."""
        lines = lambda: F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
        a = self.short.withColumn("repaired_sha256", F.sha2(F.array_join(lines(), "\n").cast("binary"), 256)).drop("turns")
        if self.long_report is None:
            return a
        chunks = self.long_pieces.where(F.size("turns") > 0).select(_key().alias("k"), "part", "seq", F.array_join(lines(), "\n").alias("chunk"))
        sums = chunks.repartition("k").sortWithinPartitions("k", "part", "seq").mapInArrow(_digest_streams, "k string, sha string")
        b = self.long_report.withColumn("k", _key()).join(sums, "k", "left")
        none = F.lit(hashlib.sha256(b"").hexdigest())
        return a.unionByName(b.withColumn("repaired_sha256", F.coalesce("sha", none)).drop("k", "sha"))


def _key() -> Column:
    """A conversation's id as text that isn't null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _digest_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order; a conversation's digest is carried on, its text isn't held."""
    row = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k]), pa.array([h.hexdigest()])], ["k", "sha"])
    at, h = None, None
    for batch in batches:
        for k, chunk in zip(batch.column("k"), batch.column("chunk"), strict=True):
            k, chunk = k.as_py(), chunk.as_py().encode()
            if k != at:
                if h:
                    yield row(at, h)
                at, h = k, hashlib.sha256(chunk)
            else:
                h.update(b"\n" + chunk)
    if h:
        yield row(at, h)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _repair_short(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows k, conv_id, turn, role, text, copies, fault: a row for each conversation."""
    out: list[dict] = []
    held, at, conv, rows, seen = 0, None, None, [], set()

    def close() -> None:
        report, turns = repair(rows)
        out.append({"conv_id": conv, **report, "turns": turns})

    for k, conv_id, turn, role, text, copies, fault in _streamed(batches):
        if k != at:
            if at is not None:
                close()
            at, conv, rows, seen = k, conv_id, [], set()
            if held > PIECE_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        for _ in range(copies):
            rows.append((turn, role, text, 1 if fault == 1 else 2 if (role, text) in seen else fault))
            seen.add((role, text))
            held += len(text) + 64
    if at is not None:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


_WAY = "struct<start:int,end:int,cost:bigint,audit:string>"
_STATS = "struct<n:bigint,low:bigint,high:bigint,first_turn:bigint,last_turn:bigint,distinct:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,first:string,last:string>"
_ROWS = "array<struct<turn:bigint,role:string,text:string,fault:int>>"


def _piece(rows: list[Row]) -> tuple[list[dict], dict]:
    """Best ways through a piece, and what the fold needs to know of it."""
    initials, faults = [r[1][:1] for r in rows], [r[3] for r in rows]
    turns = [t for t, *_ in rows if t is not None]
    ways = [
        {"start": q, "end": e, "cost": cost, "audit": audit}
        for q in STATES
        for e, (cost, audit) in cheapest(initials, faults, q, STATES[1 if q else 0 :], each=True).items()
    ]
    stats = {
        "n": len(rows), "low": min(turns, default=None), "high": max(turns, default=None), "first_turn": rows[0][0], "last_turn": rows[-1][0],
        "distinct": len(set(turns)),
        **{name: faults.count(i) for i, name in enumerate(FAULTS) if name},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first": initials[0], "last": initials[-1],
    }
    return ways, stats


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows k, conv_id, turn, role, text, copies, fault, later: pieces of conversations."""
    part, seq = TaskContext.get().partitionId(), 0
    at, conv, rows, chars = None, None, [], 0

    def close() -> pa.RecordBatch:
        ways, stats = _piece(rows)
        held = [{"turn": t, "role": r, "text": x, "fault": f} for t, r, x, f in rows]
        return pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "seq": seq, "rows": held, "ways": ways, "stats": stats}], schema)

    for k, conv_id, turn, role, text, copies, fault, later in _streamed(batches):
        for i in range(copies):
            if rows and (k != at or len(rows) >= most_rows or chars + len(text) > most_chars):
                yield close()
                seq, rows, chars = seq + 1, [], 0
            at, conv = k, conv_id
            rows.append((turn, role, text, 1 if fault == 1 else 2 if later or i else fault))
            chars += len(text)
    if rows:
        yield close()


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces k, conv_id, part, seq, ways, stats in order: for each piece the state that the chosen way
    begins in and its edits (kind 0), for each conversation its report (kind 1). Of a conversation
    four edit strings are held and, for each piece, where the best way to each state came from."""
    at = None

    def close() -> pa.RecordBatch:
        end = min((q for q in ENDS if q in best), key=lambda q: best[q])
        cost, audit = best[end]
        # the states between pieces, from the last one back
        out, cut = [], len(audit)
        for part, seq, came in reversed(trace):
            start, n = came[end]
            out.append({"kind": 0, "conv_id": conv, "part": part, "seq": seq, "start": start, "audit": audit[cut - n : cut]})
            cut, end = cut - n, start
        counts = {name: total[name] for name in ("blank", "duplicate", "truncated", "illegal")}
        out.append({"kind": 1, "conv_id": conv, **counts, "gaps": _gaps(total["low"], total["high"], total["distinct"]), "cost": cost, "audit": audit})
        return pa.RecordBatch.from_pylist(out, schema)

    for k, conv_id, part, seq, ways, stats in _streamed(batches):
        if k != at:
            if at is not None:
                yield close()
            at, conv, best, trace = k, conv_id, {0: (0, "")}, []
            total = {"low": None, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "turn": None}
        new, came = {}, {}
        for w in ways:
            if w["start"] in best:
                cost, audit = best[w["start"]]
                way = (cost + w["cost"], audit + w["audit"])
                if w["end"] not in new or way < new[w["end"]]:
                    new[w["end"]], came[w["end"]] = way, (w["start"], len(w["audit"]))
        best = new
        trace.append((part, seq, came))
        for name in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            total[name] += stats[name]
        if total["last"] is not None:
            total["illegal"] += total["last"] + stats["first"] not in LEGAL
        # turns come in order, so only a turn that two pieces share is counted twice
        if total["turn"] is not None and total["turn"] == stats["first_turn"]:
            total["distinct"] -= 1
        total["last"], total["turn"] = stats["last"], stats["last_turn"]
        for name, pick in (("low", min), ("high", max)):
            total[name] = pick((x for x in (total[name], stats[name]) if x is not None), default=None)
    if at is not None:
        yield close()


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _in_arrow(f, df: DataFrame, ddl: str, *more) -> DataFrame:
    schema = _schema(ddl)
    return df.mapInArrow(lambda batches: f(batches, schema, *more), ddl)


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> Repairs:
    """Repairs of ``rows``: conv_id, turn bigint, role and text (not null), copies (how often a row
    counts; 0 for a row that only names its conversation), as :func:`damage_turns` gives them.

    A null conv_id is a conversation like others. Rows of one turn (nulls first) go by role and text,
    repeated rows count as often as they come. Blank and very long texts are rows like others; a
    conversation without rows has zeros and no edits; an empty table gives an empty result; further
    columns aren't looked at. Gaps beyond a bigint are the largest bigint.
    """
    r = rows.select("conv_id", "turn", "role", "text", "copies")
    kind = r.schema["conv_id"].dataType.simpleString()
    sizes = r.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.char_length("text") * F.col("copies")).alias("chars"))
    long = materialize(sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select(_key().alias("k"), "conv_id"), "repair-long")
    any_long = not long.isEmpty()
    keyed = r.withColumn("k", _key()).select("k", "conv_id", "turn", "role", "text", "copies", _fault())
    order = ("k", "turn", "role", "text")
    few = keyed.join(long.select("k"), "k", "left_anti") if any_long else keyed
    few = few.repartition("k").sortWithinPartitions(*order)
    short = _in_arrow(_repair_short, few.select(*keyed.columns), f"conv_id {kind}, {REPORT}, {TURNS}")
    if not any_long:
        discard(long)
        return Repairs(short)

    # copies are counted before rows of a long conversation move
    own = keyed.join(long.select("k"), "k", "left_semi").where("copies > 0")
    own = materialize(own.groupBy("k", "conv_id", "turn", "role", "text", "fault").agg(F.sum("copies").alias("copies")), "repair-rows")
    key = F.sha2(F.concat_ws(":", F.length("k"), "k", F.length("role"), "role", "text").cast("binary"), 256)
    narrow = own.select(key.alias("same"), "turn").groupBy("same").agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("null_first"))
    later = F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("low")))
    marked = own.withColumn("same", key).join(narrow, "same").select("k", "conv_id", "turn", "role", "text", "copies", "fault", later.alias("later"))
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = materialize(_in_arrow(_pieces, dealt, f"conv_id {kind}, part int, seq int, rows {_ROWS}, ways array<{_WAY}>, stats {_STATS}", piece_rows, piece_chars), "repair-pieces")
    ordered = pieces.select(_key().alias("k"), "conv_id", "part", "seq", "ways", "stats").repartition("k").sortWithinPartitions("k", "part", "seq")
    folded = materialize(_in_arrow(_fold, ordered, f"kind int, conv_id {kind}, part int, seq int, start int, {REPORT}"), "repair-folded")
    names = [x.split()[0] for x in REPORT.split(", ")]
    found = folded.where("kind = 1").select(_key().alias("k"), *names)
    none = {**dict.fromkeys(names, F.lit(0).cast("bigint")), "audit": F.lit("")}  # of a conversation whose rows all went
    report = long.join(found, "k", "left").select("conv_id", *(F.coalesce(c, none[c]).alias(c) for c in names))

    def edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for conv_id, part, seq, held, start, audit in _streamed(batches):
            turns = apply_edits([(x["turn"], x["role"], x["text"], x["fault"]) for x in held], audit, start)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "seq": seq, "turns": turns}], schema)

    chosen = pieces.join(folded.where("kind = 0").select("part", "seq", "start", "audit"), ["part", "seq"]).select("conv_id", "part", "seq", "rows", "start", "audit")
    return Repairs(short, report, _in_arrow(edited, chosen, f"conv_id {kind}, part int, seq int, {TURNS}"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Per conv_id of ``conversations``, damaged as :func:`damage_turns` says: gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Odd rows as in :func:`repair_conversations`."""
    return repair_conversations(damage_turns(conversations)).with_digests()
