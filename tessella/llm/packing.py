"""Packing of tokenised documents into windows, by best-fit decreasing.

Overlong documents are cut into full windows and a rest. Best-fit decreasing then looks at nothing
but lengths, and pieces of one length are interchangeable, so what is planned is one row for each
length with the number of such pieces: at most one row for each possible length, whatever the
corpus. A segment tree indexed by remaining capacity finds the tightest open window for each
length; windows of equal capacity form runs of consecutive numbers. The plan says where the pieces
of a length with ranks from .. to go; its size depends on the window alone. Spark counts the
lengths, ranks the pieces within each length, and joins them to the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import ByteBound, discard, id_and_text, materialize, text_runs

WINDOW, END_ID = 1024, 0
#: Pieces of one length that one group ranks, about.
RANKED_TOGETHER = 1_000_000
PLAN = "length int, rank_from bigint, rank_to bigint, first_sequence bigint, offset bigint, each bigint"


class CapacityTree:
    """A segment tree over remaining capacities 0 .. size: which have open windows."""

    def __init__(self, size: int) -> None:
        self.half = 1 << size.bit_length()
        self.open = [False] * (2 * self.half)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.half
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open window."""
        i = least + self.half
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:  # the right sibling holds the larger capacities
                i += 1
                while i < self.half:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.half
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_sequence, offset, each): piece number r of this
    length goes to sequence first_sequence + (r - rank_from) // each, at
    offset + (r - rank_from) % each * length."""
    tree, runs = CapacityTree(window), {}
    plan, made = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, deque()).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= window:
            raise ValueError(f"a piece of {length} tokens in windows of {window}")
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = window, made, -(-left // (window // length))
                made += n
            else:
                first, n = runs[capacity].popleft()
                if not runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // length  # a window that took a piece is the tightest for the next
            whole = min(n, left // each)
            placed = whole * each
            add(capacity - each * length, first, whole)
            rest = min(left - placed, each) if whole < n else 0
            if rest:
                add(capacity - rest * length, first + whole, 1)
            add(capacity, first + whole + bool(rest), n - whole - bool(rest))
            plan.append((length, rank, rank + placed + rest, first, window - capacity, each))
            rank, left = rank + placed + rest, left - placed - rest
    return plan


@cache
def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a byte-level tokenizer file, whose characters stand for bytes."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {x["content"]: x["id"] for x in held["added_tokens"]}
    vocab = held["model"]["vocab"].items()
    return {bytes(byte_of[c] for c in piece): i for piece, i in vocab if piece not in added}, added


@cache
def _slices(path: str) -> ByteBound:
    return bpe.slice_cache(_vocabulary(path)[0])


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text, little-endian unsigned 32-bit; strings of added tokens are those tokens."""
    added = _vocabulary(path)[1]
    found = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    parts, of = [], []
    for i, t in enumerate(texts):
        for x in found.split(t) if found and any(a in t for a in added) else [t]:
            parts.append(x)
            of.append(i)
    ids: list[list[bytes]] = [[] for _ in texts]
    plain = bpe.encode_slices([("" if x in added else x) for x in parts], _slices(path))
    for x, i, (y, _, _) in zip(parts, of, plain, strict=True):
        ids[i].append(added[x].to_bytes(4, "little") if x in added else y.tobytes())
    yield from map(b"".join, ids)


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, nth[, ids binary]): each document's ids and the
    end id, cut into full windows and a rest. nth counts the pieces that one task made, and tells
    pieces that are alike in all else apart."""
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, made = end_id.to_bytes(4, "little"), 0
        for batch in text_runs(batches, bpe.BATCH_CHARS):
            row, start, length, crc, tokens, cut = [], [], [], [], [], []
            for i, ids in enumerate(encode_texts(batch.column("text").to_pylist(), path)):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s : 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
                    if with_ids:
                        cut.append(part)
            out = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64()))}
            out |= {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", tokens))}
            out["nth"] = pa.array(range(made, made + len(row)), pa.int64())
            made += len(row)
            if with_ids:
                out["ids"] = pa.array(cut, pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    return d.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, nth bigint" + ", ids binary" * with_ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    ``path`` is a tokenizer file on every machine. Each token lies in just one piece, and a
    sequence's pieces lie in it from 0 without gaps. Null and empty texts are documents of the end
    id alone; rows without a doc_id and repeated rows are packed like others (rows alike in
    everything are interchangeable, and however many there are they fall into different groups of
    about ``RANKED_TOGETHER`` where pieces are numbered); an empty table gives an empty result;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, path, window, end_id, with_ids, id_col, text_col), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # a row a length
    plan = spark.createDataFrame(best_fit_decreasing(counts, window), PLAN)

    groups = max(64, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("n", F.row_number().over(within)).join(base, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("n") - 1)
    at = F.col("rank") - F.col("rank_from")
    placed = ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "planned")),  # its size is bounded by the window
        (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - rank_from) div each")).cast("long").alias("sequence_id"),
        (F.col("offset") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
