"""Byte-level BPE without a regular expression in the hot path.

Pre-tokenisation: every code point has a class (letter, number, blank, other space, other), and a
little look-ahead turns classes into 8 symbols (an apostrophe that opens a contraction of one or
two letters, the last space of a run before something else, ...). Cutting a text is then a finite
automaton of 8 states over these symbols. A symbol's transition function is an element of a small
finite monoid, so functions compose by a table look-up, composition is associative, and the state
at every position comes from a blocked scan over all positions of a batch at once: fold each
block, scan the folds by doubling, replay the blocks. The first character of each document is a
symbol of its own that resets the state, so documents are cut in one array without mixing.

Merging: the slices of a batch are made distinct by Arrow; those that the worker's cache, bounded by
bytes, doesn't hold are merged together, by rank, in rounds of one merge a slice. So a text whose
words are all new costs numpy passes, not a Python loop for each word. With the ids stay, for each slice, the code point where it starts and the number of ids up
to its end: decoding goes slice by slice, checks that they fit, and can start anywhere.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructType

from .common import ByteBound, id_and_text, spans_of_chars, text_runs

#: Characters that are cut at once, and bytes of slices that a worker keeps, about.
BATCH_CHARS, CACHE_BYTES = 1 << 20, 128 << 20
#: Bytes of slices that are merged without a heap, and the rank of what is no pair.
SHORT, NO_PAIR = 64, (1 << 63) - 1

# Symbols and states of the automaton.
L, N, O, Q1, Q2, WS, WS_LAST, BLANK_LAST = range(8)
IN_L, IN_N, IN_O, IN_WS, BLANK, LEFT1, LEFT2, SHUT = range(8)
#: Added to the symbol of a document's first character.
FIRST = 8
#: White space, by the Unicode property of that name.
SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether the character starts a slice."""
    if symbol >= FIRST:
        state, symbol = SHUT, symbol - FIRST
    if symbol == L and state in (LEFT1, LEFT2):
        return (SHUT if state == LEFT1 else LEFT1), False
    if symbol in (L, N, O):
        run = (IN_L, IN_N, IN_O)[symbol]
        return run, state not in (run, BLANK)
    if symbol in (Q1, Q2):
        return (IN_O, False) if state in (IN_O, BLANK) else ((LEFT1, LEFT2)[symbol - Q1], True)
    if symbol == WS:
        return IN_WS, state != IN_WS
    return (SHUT if symbol == WS_LAST else BLANK), True


@cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """NEXT[state, symbol], START[state, symbol], the monoid element of each symbol, the table of
    compositions, and each element's image of the state SHUT."""
    steps = [[_step(s, x) for x in range(16)] for s in range(8)]
    elements = [tuple(range(8)), *(tuple(steps[s][x][0] for s in range(8)) for x in range(16))]
    seen = {}
    for e in elements:
        seen.setdefault(e, len(seen))
    todo = list(seen)
    while todo:  # close under composition
        e = todo.pop()
        for g in list(seen):
            for c in (tuple(g[x] for x in e), tuple(e[x] for x in g)):
                if c not in seen:
                    seen[c] = len(seen)
                    todo.append(c)
    table = np.array([[seen[tuple(g[x] for x in e)] for g in seen] for e in seen], np.int32)
    return (
        np.array([[steps[s][x][0] for x in range(16)] for s in range(8)], np.uint8),
        np.array([[steps[s][x][1] for x in range(16)] for s in range(8)], np.bool_),
        np.array([seen[e] for e in elements[1:]], np.int32),
        table,
        np.array([e[SHUT] for e in seen], np.uint8),
    )


@cache
def _classes() -> np.ndarray:
    """The symbol of every code point on its own: L, N, O, or WS."""
    kinds = {"L": L, "N": N}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], O) for i in range(sys.maxunicode + 1)), np.uint8)
    out[list(SPACES)] = WS
    return out


def slice_starts(text: str, firsts: np.ndarray) -> np.ndarray:
    """Where the slices start in joined documents; ``firsts`` has where each non-empty one starts."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    nxt, start, element, compose, from_shut = _automaton()
    sym = _classes()[cp]
    head = np.zeros(n + 2, bool)
    head[firsts] = head[n] = head[n + 1] = True
    quote = np.flatnonzero(cp == 39)
    if len(quote):
        padded = np.r_[cp, np.zeros(2, np.uint32)]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & ~head[quote + 1]
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~head[quote + 1] & ~head[quote + 2]
        sym[quote[one]], sym[quote[two]] = Q1, Q2
    space = np.flatnonzero(sym == WS)
    last = space[(~head[space + 1]) & (np.r_[sym, WS][space + 1] != WS)]
    sym[last] = WS_LAST
    sym[last[cp[last] == 32]] = BLANK_LAST
    sym[firsts] += FIRST

    width = 64
    rows = -(-n // width)
    by_column = np.full(rows * width, L, np.uint8)
    by_column[:n] = sym
    by_column = np.ascontiguousarray(by_column.reshape(rows, width).T)
    fold = element[by_column[0]]
    flat, k = compose.ravel(), compose.shape[1]
    for column in by_column[1:]:
        fold = flat[fold * k + element[column]]
    far = 1
    while far < rows:  # inclusive scan by doubling
        fold[far:] = flat[fold[:-far] * k + fold[far:]]
        far *= 2
    state = np.r_[np.uint8(SHUT), from_shut[fold[:-1]]].astype(np.uint8)
    begins = np.empty((width, rows), bool)
    flat_next, flat_start = nxt.ravel(), start.ravel()
    for i, column in enumerate(by_column):
        at = (state << 4) | column
        begins[i] = flat_start[at]
        state = flat_next[at]
    return np.flatnonzero(begins.T.ravel()[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of lowest rank, leftmost first, is merged again and again."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no part starts here
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[i], end[j] = e, 0
        after[i] = e
        if e < n:
            before[e] = i
            if (r := ranks.get(piece[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
            heapq.heappush(heap, (r, h, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for short slices, without a heap."""
    none = 1 << 32
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) != none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[x] for x in parts]


class PairRanks:
    """The ids of single bytes, and the rank of each pair of ids whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte = np.array([ranks[bytes((b,))] for b in range(256)], np.int64)
        pairs = sorted((a << 32 | b, r) for x, r in ranks.items() for i in range(1, len(x)) if (a := ranks.get(x[:i])) is not None and (b := ranks.get(x[i:])) is not None)
        self.key = np.array([k for k, _ in pairs] + [NO_PAIR], np.int64)
        self.rank = np.array([r for _, r in pairs] + [NO_PAIR], np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], NO_PAIR)


def merge_together(pieces: list[bytes], pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`merge` gives for each of many short slices that are no tokens themselves: all ids,
    and how many each slice has. A round merges one pair in every slice that still has one."""
    of = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
    ids = pairs.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full(len(ids), NO_PAIR)  # of the pair that begins here

    def look_up(at: np.ndarray) -> None:
        rank[at] = NO_PAIR
        at = at[at + 1 < len(ids)]
        at = at[of[at] == of[at + 1]]
        rank[at] = pairs.of(ids[at], ids[at + 1])

    look_up(np.arange(len(ids)))
    ended = [(of[:0], ids[:0])]
    while len(ids):
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        size = np.diff(np.r_[first, len(ids)])
        low = np.minimum.reduceat(rank, first)
        on = low != NO_PAIR
        if not on.all():
            rest = np.repeat(on, size)
            ended.append((of[~rest], ids[~rest]))
            of, ids, rank, low, size = of[rest], ids[rest], rank[rest], low[on], size[on]
        hit = np.flatnonzero(rank == np.repeat(low, size))
        hit = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]][: len(hit)]]  # the leftmost of each slice
        ids[hit] = low
        rest = np.ones(len(ids), bool)
        rest[hit + 1] = False
        of, ids, rank = of[rest], ids[rest], rank[rest]
        hit -= np.arange(len(hit))
        look_up(np.r_[hit[hit > 0] - 1, hit])
    of, ids = (np.concatenate(x) for x in zip(*ended, strict=True))
    return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(pieces))


def slice_cache(ranks: dict[bytes, int]) -> ByteBound:
    """Each slice's ids as little-endian unsigned 32-bit integers."""
    pairs = PairRanks(ranks)

    def made(piece: bytes) -> bytes:
        ids = merge(piece, ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def made_together(pieces: list[bytes]) -> list[bytes]:
        short = [x for x in pieces if len(x) <= SHORT and x not in ranks]
        ids, size = merge_together(short, pairs)
        data = ids.astype("<u4").tobytes()
        found = dict(zip(short, (data[a:b] for a, b in pairwise([0, *(4 * np.cumsum(size)).tolist()])), strict=True))
        return [found[x] if x in found else made(x) for x in pieces]

    return ByteBound(made, lambda piece, ids: 200 + len(piece) + len(ids), CACHE_BYTES, made_together)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def slices(path: str) -> ByteBound:
    return slice_cache(ranks(path))


Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


def encode_texts(texts: list[str], path: str) -> Iterator[Encoded]:
    """For each text its ids; for each of its slices the code point where it starts; and the number
    of ids up to its end."""
    return encode_slices(texts, slices(path))


def encode_slices(texts: list[str], held: ByteBound) -> Iterator[Encoded]:
    lengths = [len(t) for t in texts]
    for lo, hi in spans_of_chars(lengths, BATCH_CHARS):
        ids, starts, ends = _encode_run(texts[lo:hi], held)
        bounds = np.r_[0, np.cumsum(lengths[lo:hi])]
        cut = np.searchsorted(starts, bounds)
        at = np.r_[0, ends][cut]
        for i in range(hi - lo):
            a, b = cut[i], cut[i + 1]
            yield ids[at[i] : at[i + 1]], starts[a:b] - bounds[i], ends[a:b] - at[i]


def _encode_run(texts: list[str], held: ByteBound) -> Encoded:
    """The same for joined texts, none of which shares a slice with another."""
    joined = "".join(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    starts = slice_starts(joined, np.unique(bounds[:-1][np.diff(bounds) > 0]))
    if not len(starts):
        return np.zeros(0, "<u4"), starts, starts
    data = joined.encode()
    at = np.r_[starts, len(joined)]
    if len(data) > len(joined):  # from code points to bytes
        at = np.r_[np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)][at]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
    found = pa.array(held.all_of(_values(coded.dictionary)), pa.large_binary()).take(coded.indices)
    _, ends, ids = found.buffers()
    ends = np.frombuffer(ends, np.int64)[1 : len(found) + 1] >> 2
    return np.frombuffer(ids, "<u4")[: ends[-1]], starts, ends


def _values(x: pa.Array) -> list[bytes]:
    """Of a large binary array without nulls, cut from its bytes: to_pylist takes four times as long."""
    _, bounds, data = x.buffers()
    bounds = np.frombuffer(bounds, np.int64)[x.offset : x.offset + len(x) + 1].tolist()
    data = data.to_pybytes()
    return [data[a:b] for a, b in pairwise(bounds)]


def _cut(data: bytes, bounds: np.ndarray) -> pa.Array:
    """One value for each pair of neighbouring bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id and, as little-endian unsigned 32-bit integers in binary columns, ids;
    offsets: the code point where each pre-token starts; ends: the number of ids up to its end.

    ``path`` is a rank file on every machine. Special tokens are not looked for: their strings are
    ordinary text. Null and empty texts have no ids; rows without a doc_id, repeated rows and
    other columns do no harm; an empty table gives an empty result. Whole texts, of any length.
    """
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            found = list(encode_texts(batch.column("text").to_pylist(), path))
            columns = {c: pa.array([_packed(x[i]) for x in found], pa.binary()) for i, c in enumerate(("ids", "offsets", "ends"))}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **columns})

    return d.mapInArrow(run, f"doc_id {kind}, ids binary, offsets binary, ends binary")


@cache
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens, and where each token's start and how many they are."""
    held = sorted((i, piece) for piece, i in ranks(path).items())
    size = np.zeros(held[-1][0] + 1 if held else 0, np.int64)
    size[[i for i, _ in held]] = [len(x) for _, x in held]
    return np.frombuffer(b"".join(x for _, x in held), np.uint8), np.cumsum(size) - size, size


def decode_slices(ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray, path: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """The bytes of the slices ``first`` .. ``last`` - 1, all by default, as an array. A slice whose
    bytes don't begin where its offset says is an error."""
    last = len(ends) if last is None else last
    if first >= last:
        return np.zeros(0, np.uint8)
    flat, start, size = _token_table(path)
    begin = int(ends[first - 1]) if first else 0
    ids = ids[begin : int(ends[last - 1])]
    n = size[ids]
    after = np.cumsum(n)
    out = flat[np.arange(after[-1]) + np.repeat(start[ids] - (after - n), n)]
    heads = np.cumsum((out & 0xC0) != 0x80)  # characters begun up to each byte
    at = heads[after[ends[first:last].astype(np.int64) - begin - 1] - 1]
    if (at[:-1] != offsets[first + 1 : last].astype(np.int64) - int(offsets[first])).any():
        raise ValueError("the ids don't fit the offsets of their slices")
    return out


def decode_between(ids: np.ndarray, offsets: np.ndarray, ends: np.ndarray, path: str, start: int, end: int) -> str:
    """Characters ``start`` .. ``end`` - 1 of a text, from the slices that hold them alone."""
    first = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
    last = int(np.searchsorted(offsets, end))
    if first >= last:
        return ""
    from_here = int(offsets[first])
    return decode_slices(ids, offsets, ends, path, first, last).tobytes().decode()[max(0, start - from_here) : max(0, end - from_here)]


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of :func:`bpe_encode` with a column decoded binary: the bytes of the ids, slice by
    slice. Null ids give null; an id outside the vocabulary, or ids that don't fit the offsets, are
    an error. An empty table gives an empty result; repeated rows and further columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in spans_of_chars([len(x or b"") for x in whole.column("ids").to_pylist()], 4 * BATCH_CHARS):
                batch = whole.slice(lo, hi - lo)
                rows = zip(*(batch.column(c).to_pylist() for c in ("ids", "offsets", "ends")), strict=True)
                out = [None if row[0] is None else decode_slices(*(np.frombuffer(x, "<u4") for x in row), path).tobytes() for row in rows]
                yield batch.append_column("decoded", pa.array(out, pa.binary()))

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", BinaryType()))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, ids, decoded, in one pass: what :func:`bpe_decode` gives for
    :func:`bpe_encode`, with the offsets used where they are made. Odd rows as there."""
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            texts = batch.column("text").to_pylist()
            ids, starts, ends = _encode_run(texts, slices(path))
            decoded = decode_slices(ids, starts, ends, path)
            bounds = np.cumsum([0, *map(len, texts)])
            ids_up_to = np.r_[0, ends][np.searchsorted(starts, bounds)]
            bytes_up_to = np.r_[np.flatnonzero((decoded & 0xC0) != 0x80), len(decoded)][bounds]
            columns = [_cut(ids.astype("<u4").tobytes(), 4 * ids_up_to), _cut(decoded.tobytes(), bytes_up_to)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "ids", "decoded"])

    return d.mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
