"""Fuzzy line deduplication by MinHash, keeping one line of each component.

A line is compared in lower case with white space collapsed. Equal lines are one node. Others are
candidates if a band of their MinHash signatures over character shingles agrees; a candidate pair
becomes a link only if the exact Jaccard likeness of the shingle sets reaches the threshold; links
form components by distributed union-find, and of each component the first line stays.

Signatures: lines of up to ``PERMUTED`` distinct shingles take a minimum under each of
``BANDS * ROWS`` hash functions; lines of ``BINNED`` shingles or more take the minimum of each of as
many bins of one function, which costs one hash a shingle. Two lines at the threshold differ in
distinct shingles by no more than its inverse, so they share at least one kind. Ten bands of four
find a pair at likeness 0.8 with probability 0.995 or more.

Verification compares all pairs of a candidate group that an exact prefix filter leaves: a line of
n shingles can only reach the threshold with one that shares one of its n - ceil(0.8 n) + 1 rarest
shingles, and pairs that are joined already need no comparison. So neither a group of near copies
nor one that a common passage made costs all its pairs. A group over ``BLOCK`` lines or
``BLOCK_CHARS`` characters isn't walked in one task; the same filter is then applied by joins
(:func:`_large_group_links`).

What moves over the cluster: a band key and line hash for each band of each line, the texts of the
candidates alone, line numbers, and the documents for the join with the lines they lose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spans_of_chars, text_runs
from .graph import components

SHINGLE, THRESHOLD = 8, 0.8
BANDS, ROWS = 10, 4
BINNED, PERMUTED = 96, 120  # PERMUTED >= BINNED / THRESHOLD
BATCH_CHARS, SEED = 1 << 19, 11
#: Characters whose shingles are hashed at once: a processor's cache holds them.
HASHED_CHARS = 1 << 17
#: Lines and characters of a candidate group that one step compares, and line hashes that a worker
#: remembers.
BLOCK, BLOCK_CHARS, SEEN_LINES = 2048, 3 << 19, 1 << 17
#: Groups of up to so many lines count what all their pairs share.
COUNTED = 128
#: Bits of the filter by which lines that are no candidates are left out early.
FILTER_BITS = 26
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64((1 << 64) - 1)
#: What a text must hold for collapsing white space to change anything but its lines' case: a run
#: of blanks, a blank at a line's end, or another space.
_SPACES = ("  ", " \n", "\n ", *(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"))


def normal_lines(text: str) -> list[str]:
    """Each line as it is compared; a blank one is empty."""
    low = text.lower()
    lines = low.split("\n")
    if low[:1] == " " or low[-1:] == " " or any(x in low for x in _SPACES):
        return [" ".join(x.split()) for x in lines]
    return lines


def line_hash(line: str) -> int:
    """Signed 64-bit."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    x *= _BASE
    x ^= x >> np.uint64(32)
    return x


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines' shingles, line by line, and how many each line has."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    n = np.maximum(length - SHINGLE + 1, 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    h = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    step, by = 1, np.array([_BASE])
    while step < SHINGLE:  # the hash of 2, 4, 8 characters from those of halves
        x = h[:-step] * by
        x += h[step:]
        h = x
        step, by = 2 * step, by * by
    before = np.cumsum(length) - length - (np.cumsum(n) - n)
    return _mixed(h[np.arange(n.sum()) + np.repeat(before, n)]), n


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def _few(least: np.ndarray, many: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which lines have at most ``PERMUTED`` distinct shingles. Of a line with more, all bins but
    one are filled almost surely; only the others' shingles are counted."""
    few = (n > 0) & (n <= PERMUTED)
    ends = np.cumsum(n)
    for i in many[(least == _EMPTY).sum(axis=1) > 1]:
        if not few[i]:
            few[i] = len(_distinct(h[ends[i] - n[i] : ends[i]])) <= PERMUTED
    return np.flatnonzero(few)


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of line, band key) for every band of every line of at least one shingle."""
    h, n = shingle_hashes(lines)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, parts = BANDS * ROWS, []
    many = np.flatnonzero(n >= BINNED)
    x = h[np.repeat(n >= BINNED, n)]
    spot = ((x >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).view(np.int64)
    spot += np.repeat(np.arange(len(many)) * size, n[many])
    least = np.full(len(many) * size, _EMPTY)
    x *= _MIX
    np.minimum.at(least, spot, x)
    least = least.reshape(-1, size)
    few = _few(least, many, h, n)
    if len(many):
        while (gap := least == _EMPTY).any():  # an empty bin borrows from the next
            least = np.where(gap, np.where(np.roll(gap, -1, axis=1), _EMPTY, np.roll(least, -1, axis=1) ^ _BASE), least)
        parts.append((many, least, BANDS))
    if len(few):
        chosen = np.zeros(len(lines), bool)
        chosen[few] = True
        x = (h[np.repeat(chosen, n)] >> np.uint64(20)).astype(np.uint32)
        first, made = np.r_[0, np.cumsum(n[few])[:-1]], np.empty_like(x)
        least = np.empty((len(few), size), np.uint64)
        for i, a in enumerate(_FACTORS):
            least[:, i] = np.minimum.reduceat(np.multiply(x, a, out=made), first)
        parts.append((few, least, 0))
    which, keys = [], []
    for lines_at, least, kind in parts:
        rows = least.reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(kind, kind + BANDS, dtype=np.uint64), rows.shape[:2])
        for i in range(ROWS):
            key = _mixed(key * _MIX ^ rows[:, :, i])
        which.append(np.repeat(lines_at, BANDS))
        keys.append(key.ravel().view(np.int64))
    return np.concatenate(which), np.concatenate(keys)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, number, h) for each line that isn't blank; where the worker meets a line of a shingle
    or more for the first time, as far as a bounded set remembers, its band keys as well."""
    seen: set[int] = set()
    for batch in text_runs(batches, BATCH_CHARS):
        row, number, hashes, new, new_at = [], [], [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            for k, x in enumerate(normal_lines(t)):
                if x:
                    h = line_hash(x)
                    if len(x) >= SHINGLE and h not in seen:
                        seen.add(h)
                        new.append(x)
                        new_at.append(len(row))
                    row.append(i)
                    number.append(k)
                    hashes.append(h)
        of_parts = [(lo, *band_keys(new[lo:hi])) for lo, hi in spans_of_chars([len(x) for x in new], HASHED_CHARS)]
        which = np.concatenate([np.zeros(0, np.int64), *(lo + w for lo, w, _ in of_parts)])
        keys = np.concatenate([np.zeros(0, np.int64), *(k for _, _, k in of_parts)])
        order = np.argsort(which, kind="stable")
        sizes = np.zeros(len(row) + 1, np.int64)
        sizes[1:][new_at] = np.bincount(which, minlength=len(new))
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(at), batch.column("th").take(at), pa.array(number, pa.int32()), pa.array(hashes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(keys[order])),
            ],
            ["id", "th", "number", "h", "keys"],
        )
        if len(seen) > SEEN_LINES:
            seen.clear()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h) for the distinct line hashes of each band key that has two or more; g is the least of
    them, so the groups that bands make of about the same lines fall together. The rows come sorted
    by key and hash, so the first of a key is g and nothing of a group is held."""
    key = g = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, h = batch.column("k").to_numpy(), batch.column("h").to_numpy()
        first = np.flatnonzero(np.r_[k[0] != key, k[1:] != k[:-1]])
        start = h[first]
        if not len(first) or first[0]:  # the last key goes on
            first, start = np.r_[0, first], np.r_[g, start]
        group = np.repeat(start, np.diff(np.r_[first, len(k)]))
        other = group != h
        key, g = k[-1], group[-1]
        group, h = group[other], h[other]
        least = np.unique(group)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[least, group]), pa.array(np.r_[least, h])], ["g", "h"])


def _filter_bits(groups: DataFrame) -> np.ndarray:
    """A bitmap of 2 to the ``FILTER_BITS`` bits, one for each candidate line's hash modulo that: its
    size doesn't grow with the candidates, it only leaves out less."""
    spot = F.pmod(F.col("h"), F.lit(1 << FILTER_BITS)) + 1
    parts = groups.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    out = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in parts:
        out[(r["b"] - 1) << 12 : r["b"] << 12] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _candidate_texts(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """(h, line) of the lines that the filter lets pass."""
    held = texts.sparkSession.sparkContext.broadcast(bits)  # 2 to the FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in text_runs(batches, BATCH_CHARS):
            lines = list({x: None for t in batch.column("text").to_pylist() for x in normal_lines(t) if len(x) >= SHINGLE})
            h = np.fromiter(map(line_hash, lines), np.int64, len(lines))
            spot = h & ((1 << FILTER_BITS) - 1)
            ok = np.flatnonzero(bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array([lines[i] for i in ok], pa.string())], ["h", "line"])

    return texts.mapInArrow(run, "h bigint, line string")


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of each line's shingles."""
    h, n = shingle_hashes(lines)
    ends = np.cumsum(n).tolist()
    return [_distinct(h[a:b]) for a, b in pairwise([0, *ends])]


def _reaches(both: int, a: int, b: int) -> bool:
    return both >= THRESHOLD * (a + b - both)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the likeness of two sets of :func:`shingle_sets` reaches the threshold."""
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    x = np.concatenate((a, b))
    x.sort()
    return _reaches(int(np.count_nonzero(x[1:] == x[:-1])), len(a), len(b))


def prefix_size(n: int) -> int:
    """How many of a line's n shingles, in an order that all lines share, a line alike to it must hit."""
    return n - math.ceil(THRESHOLD * n - 1e-9) + 1


def _shared_counts(code: np.ndarray, row: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """How many shingles each pair of n lines shares, by products of 0/1 matrices of some columns."""
    shared = np.cumsum(count > 1) - 1
    keep = count[code] > 1
    code, row = shared[code[keep]], row[keep]
    total, width = np.zeros((n, n), np.float32), max(1, min((1 << 20) // n, int(shared[-1]) + 1))
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for lo in range(0, int(shared[-1]) + 1, width):
        a, b = np.searchsorted(code, (lo, lo + width))
        x = np.zeros((n, width), np.float32)
        x[row[a:b], code[a:b] - lo] = 1
        total += x @ x.T
    return total


def links_in(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, smallest of its component) that join the lines of a candidate group as all pairs
    above the threshold would.

    With shingles in order of their rarity in the group, lines are compared only if enough of their
    prefixes agree: of the shingles that two lines at the threshold share, those not in both
    prefixes lie in what follows one of the prefixes. Lines of one component aren't compared.
    """
    n = len(sets)
    label = np.arange(n)

    def join(i: int, j: int) -> None:
        x, y = sorted((label[i], label[j]))
        label[label == y] = x

    if n <= 8:
        for i, j in combinations(range(n), 2):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                join(i, j)
        return [(i, int(label[i])) for i in range(n) if label[i] != i]

    sizes = np.array([len(s) for s in sets])
    tokens, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    if n <= COUNTED:
        both = _shared_counts(inverse, np.repeat(np.arange(n), sizes), count, n)
        for i, j in np.argwhere(np.triu(both >= THRESHOLD * (sizes[:, None] + sizes - both), 1)).tolist():
            if label[i] != label[j]:
                join(i, j)
        return [(i, int(label[i])) for i in range(n) if label[i] != i]

    rank = np.empty(len(tokens), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(tokens), dtype=np.int32)
    code, row = rank[inverse], np.repeat(np.arange(n, dtype=np.int32), sizes)
    del tokens, inverse
    code = code[np.lexsort((code, row))]  # each line's shingles, rarest first
    starts = np.cumsum(sizes) - sizes
    prefix = np.array([prefix_size(int(s)) for s in sizes])
    in_prefix = np.arange(len(code)) - np.repeat(starts, sizes) < np.repeat(prefix, sizes)
    order = np.lexsort((row[in_prefix], code[in_prefix]))
    lines_of = row[in_prefix][order]  # of each shingle, the lines with it in their prefix
    first = np.searchsorted(code[in_prefix][order], np.arange(len(count) + 1))
    held = np.zeros(len(count), bool)
    for i in range(1, n):
        own = code[starts[i] : starts[i] + sizes[i]]
        lo, hi = first[own[: prefix[i]]], first[own[: prefix[i]] + 1]
        met = lines_of[np.arange((hi - lo).sum()) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
        agree = np.bincount(met, minlength=i)[:i]
        least = np.ceil(THRESHOLD / (1 + THRESHOLD) * (sizes[i] + sizes[:i]) - 1e-9)
        near = (agree > 0) & (agree >= least - np.maximum(sizes[i] - prefix[i], sizes[:i] - prefix[:i])) & (label[:i] != label[i])
        held[own] = True
        todo, step = np.flatnonzero(near), 4
        while len(todo):
            part, todo = todo[:step], todo[step:]
            size = sizes[part]
            before = np.cumsum(size) - size
            both = np.add.reduceat(held[code[np.arange(size.sum()) + np.repeat(starts[part] - before, size)]], before, dtype=np.int64)
            hits = part[both >= THRESHOLD * (sizes[i] + size - both)]
            for j in hits.tolist():
                if label[j] != label[i]:
                    join(i, j)
            if len(hits):
                todo = todo[label[todo] != label[i]]
            step = min(2 * step, 256)
        held[own] = False
    return [(i, int(label[i])) for i in range(n) if label[i] != i]


def _walk(batches: Iterator[pa.RecordBatch], key: str, bounded: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of whole groups by ``key``; the rows come sorted by it, and the last group waits
    for the next batch. If ``bounded``, a group over ``BLOCK`` or ``BLOCK_CHARS`` gives a row
    (group, null) instead and isn't held."""
    held_h: list[int] = []
    held: list[str] = []
    chars, current, skipped = 0, None, None

    def links(h: list[int], lines: list[str], cuts: list[int]) -> Iterator[tuple[int, int]]:
        for a, b in spans_of_chars([sum(map(len, lines[x:y])) for x, y in pairwise(cuts)], BATCH_CHARS // 2):
            sets = shingle_sets(lines[cuts[a] : cuts[b]])
            for x, y in pairwise(cuts[a : b + 1]):
                yield from ((h[x + i], h[x + j]) for i, j in links_in(sets[x - cuts[a] : y - cuts[a]]))

    for batch in batches:
        found: list[tuple[int, int | None]] = []
        keys, h, lines = batch.column(key).to_numpy(), batch.column("h").to_pylist(), batch.column("line").to_pylist()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))).tolist() if len(keys) else []
        whole = [0]  # groups that lie in this batch and aren't too large, to be walked together
        whole_h: list[int] = []
        whole_lines: list[str] = []
        for lo, hi in pairwise([*first, len(keys)]):
            k = int(keys[lo])
            if k != current:
                whole_h += held_h
                whole_lines += held
                if held:
                    whole.append(len(whole_h))
                current, held_h, held, chars = k, [], [], 0
            if k == skipped:
                continue
            held_h, held, chars = held_h + h[lo:hi], held + lines[lo:hi], chars + sum(map(len, lines[lo:hi]))
            if bounded and (len(held) > BLOCK or chars > BLOCK_CHARS):
                found.append((k, None))
                held_h, held, chars, skipped = [], [], 0, k
        yield _pairs([*found, *links(whole_h, whole_lines, whole)])
    yield _pairs(list(links(held_h, held, [0, len(held)])) if held else [])


def _pairs(links: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _walk_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _walk(batches, "g", True)


def _walk_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _walk(batches, "block", False)


def _like_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each line is like its group's pivot."""
    for batch in text_runs(batches, BATCH_CHARS, col="line"):
        pivots = batch.column("pivot").to_pylist()
        of = dict(zip(distinct := list(dict.fromkeys(pivots)), shingle_sets(distinct), strict=True))
        near = [alike(x, of[p]) for x, p in zip(shingle_sets(batch.column("line").to_pylist()), pivots, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("h"), batch.column("line"), pa.array(near, pa.bool_())], ["g", "h", "line", "near"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, h, near, s, most) for each shingle of a line; most is the size of its prefix."""
    for batch in text_runs(batches, BATCH_CHARS, col="line"):
        sets = shingle_sets(batch.column("line").to_pylist())
        at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        most = np.repeat([prefix_size(len(s)) for s in sets], [len(s) for s in sets])
        flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("g", "h", "near")), pa.array(flat), pa.array(most, pa.int64())], ["g", "h", "near", "s", "most"])


def _large_group_links(told: DataFrame) -> DataFrame:
    """Links (a, b) of groups of any size, as exact as those of small ones, with no group in one task.

    Each line is compared with the group's pivot, its least hash, by a join, and linked to it if
    alike, so only pairs with a line that isn't (a rest) can add links. The prefix filter, with
    shingles by their rarity in the group, then makes smaller groups: lines that share a prefix
    shingle, one of them a rest. These are walked, in pairs of parts where they are still too large.
    """
    pivots = told.where("g = h").select("g", F.col("line").alias("pivot"))
    seen = materialize(told.join(pivots, "g").select("g", "h", "line", "pivot").mapInArrow(_like_pivot, "g bigint, h bigint, line string, near boolean"), "lines-pivots")
    open_groups = seen.where("not near").select("g").distinct()
    told_of = seen.join(open_groups, "g", "left_semi")
    each = materialize(told_of.mapInArrow(_shingle_rows, "g bigint, h bigint, near boolean, s bigint, most bigint"), "lines-shingles")
    ranked = each.join(each.groupBy("g", "s").agg(F.count("*").alias("n")).where("n > 1"), ["g", "s"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rarest = Window.partitionBy("g", "h").orderBy("n", "s")  # the shingles of one line
    prefix = materialize(ranked.withColumn("place", F.row_number().over(rarest)).where("place <= most and n > 1").select("g", "h", "near", "s"), "lines-prefixes")
    meet = prefix.groupBy("g", "s").agg(F.min("h").alias("least"), F.count("*").alias("n"), F.min("near").alias("all_near")).where("n > 1 and not all_near")
    part = prefix.join(meet.select("g", "s", "least"), ["g", "s"]).select("g", "h", "least").distinct()
    lines = materialize(part.join(seen.select("g", "h", F.col("line")), ["g", "h"]).select("g", "least", "h", "line"), "lines-parts")
    sizes = lines.groupBy("g", "least").agg(F.greatest(F.count("*") / (BLOCK / 2), F.sum(F.octet_length("line")) / (BLOCK_CHARS / 2)).alias("k"))
    dealt = lines.join(sizes.select("g", "least", F.ceil("k").alias("k")), ["g", "least"])
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("h"), F.col("k"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    blocks = dealt.select(F.xxhash64("g", "least", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "h", "line")
    walked = blocks.repartition("block").sortWithinPartitions("block", "h").mapInArrow(_walk_blocks, "a bigint, b bigint")
    return seen.where("near and g <> h").select(F.col("h").alias("a"), F.col("g").alias("b")).unionByName(walked)


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("text is not null")
    kind = d.schema["id"].dataType.simpleString()
    return materialize(d.mapInArrow(_lines, f"id {kind}, th bigint, number int, h bigint, keys array<bigint>"), "lines-at")


def _components(docs: DataFrame, at: DataFrame, text_col: str) -> DataFrame:
    """(h, root) of the lines that are like another line without being equal to it."""
    keyed = at.where(F.size("keys") > 0).select(F.explode("keys").alias("k"), "h").repartition("k").sortWithinPartitions("k", "h")
    groups = materialize(keyed.mapInArrow(_groups, "g bigint, h bigint").distinct(), "lines-groups")
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    lines = _candidate_texts(texts, _filter_bits(groups)).groupBy("h").agg(F.first("line").alias("line"))
    told = materialize(groups.join(lines, "h").select("g", "h", "line"), "lines-told")
    walked = materialize(told.repartition("g").sortWithinPartitions("g", "h").mapInArrow(_walk_groups, "a bigint, b bigint"), "lines-walked")
    links, large = walked.where("b is not null"), walked.where("b is null").select(F.col("a").alias("g")).distinct()
    if not large.isEmpty():
        links = links.unionByName(_large_group_links(told.join(large, "g", "left_semi")))
    out = components(links).select(F.col("node").alias("h"), "root")
    discard(groups, told, walked)
    return out


def line_components(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, root) of the lines that are like another line without being equal to it."""
    return _components(docs, _line_table(docs, text_col, text_col), text_col)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, dropped array<int>): for documents that lose lines, their numbers from 0; th is a
    hash of the text, which tells rows of one id apart."""
    at = _line_table(docs, id_col, text_col)
    root = _components(docs, at, text_col)
    linked = root.unionByName(root.select(F.col("root").alias("h"), "root").distinct())
    at = at.select("h", F.struct("id", "th", "number").alias("x"))
    each = at.groupBy("h").agg(F.min("x").alias("first"), F.count("*").alias("n")).join(linked, "h", "left")
    again = materialize(each.where("n > 1 or root is not null").select("h", "first", "root"), "lines-again")
    in_components = again.where("root is not null")
    of_root = in_components.groupBy("root").agg(F.min("first").alias("first"))
    first = again.where("root is null").select("h", "first").unionByName(in_components.select("h", "root").join(of_root, "root").select("h", "first"))
    gone = at.join(first, "h").where(F.col("x") != F.col("first")).select("x.*")
    return gone.groupBy("id", "th").agg(F.collect_set("number").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of lines that stay, and n_lines (not blank) and n_removed.

    Of the lines of a component the first by id, text hash and line number stays, nulls first.
    Blank lines stay. Null and empty texts stay as they are, with no lines; rows that agree in id
    and text lose the same lines; further columns are kept (n_lines and n_removed are replaced); an
    empty table gives an empty result. Lines shorter than a shingle are only alike if equal. A text
    without line breaks is one line, of any length, and is compared whole.
    """
    dropped = dropped_lines(docs, id_col, text_col).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("dropped").alias("__dropped"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(*kept).withColumn("__h", F.xxhash64(text_col))
    d = d.join(dropped, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    d = d.withColumn("__lines", F.split(text_col, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__dropped")
    text = F.when(F.col("__dropped").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    filled = F.size(F.filter("__lines", lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    return d.select(
        *(text.alias(c) if c == text_col else c for c in kept),
        F.when(F.col(text_col).isNull(), 0).otherwise(filled).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_removed"),
    )
