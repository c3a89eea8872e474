"""SimHash near-duplicates by a self-join of a binary trie.

The fingerprint of a text has bit i set if more than half of its word shingles' 64-bit hashes
have it set. Texts whose fingerprints differ in at most ``BUDGET`` bits are linked, and linked
texts form components.

Equal fingerprints are one node, so copies cost one row however many they are. The join walks a
binary trie over the distinct fingerprints with itself: pairs of trie nodes are expanded together
level by level, the differing bits add up, and a pair is dropped when it has more than the budget.
To deal the walk out over a cluster the 64 levels are four blocks of 16: with at most two
differing bits, two of the four blocks are equal, so each of the six choices of two blocks gives
a trie whose first 32 levels are walked without any error and which is dealt out by those levels;
the other 32 levels are walked with the full budget. No pair within the budget can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialize, text_runs
from .graph import components

SHINGLE_WORDS, SEED, BUDGET = 3, 42, 2
#: Pairs of trie nodes that are expanded at once.
FRONTIER = 1 << 17
BATCH_CHARS = 1 << 20


def fingerprint(text: str, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no word."""
    # bytes.split() cuts at just the six word breaks, and bytes.lower() changes A-Z only
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        whole, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words]).tolist()
        ends = (ends - 1).tolist()
        hashes = [digest(whole[s:e], seed) for s, e in zip(starts, ends[width - 1 :], strict=False)]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.array(hashes[at : at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_runs(batches, BATCH_CHARS):
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; the bits of the long are those of the fingerprint."""
    d = id_and_text(docs, id_col, text_col)
    return d.mapInArrow(_fingerprints, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def trie_links(group: np.ndarray, tail: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the components that the trie join finds within each group.

    ``group`` and ``tail`` (32 bits) are sorted together and without repeats. A trie node is a run
    of this order; the answer has for each entry the first entry of its component. A pair of nodes
    that lies in one component already is not walked: it can't link anything new.
    """
    n = len(tail)
    label = np.arange(n)
    key = (group.astype(np.uint64) << np.uint64(32)) | tail.astype(np.uint64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] if n else first
    more = last - first > 1
    # a pair of nodes: runs a and b, level (bits left), differing bits so far
    root = np.stack([first[more], last[more], first[more], last[more], np.full(more.sum(), 32), np.zeros(more.sum(), int)])
    stack = [root[:, i : i + FRONTIER] for i in range(0, root.shape[1], FRONTIER)]
    while stack:
        a0, a1, b0, b1, level, err = stack.pop()
        edge = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        same = (label[a0] == label[b0]) & (edge[a0] == edge[a1 - 1]) & (edge[b0] == edge[b1 - 1])
        a0, a1, b0, b1, level, err = (x[~same] for x in (a0, a1, b0, b1, level, err))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = np.bitwise_count(tail[i] ^ tail[j]) <= budget
            label = _union(label, i[near], j[near])
        a0, a1, b0, b1, level, err = (x[~leaf] for x in (a0, a1, b0, b1, level, err))
        if not len(a0):
            continue
        level = level - 1
        am, bm = _split(key, a0, a1, level), _split(key, b0, b1, level)
        own = a0 == b0
        parts = []
        for x0, x1, y0, y1, add, use in (
            (a0, am, b0, bm, 0, True),
            (am, a1, bm, b1, 0, True),
            (a0, am, bm, b1, 1, True),
            (am, a1, b0, bm, 1, ~own),
        ):
            ok = (x1 > x0) & (y1 > y0) & (err + add <= budget) & use & ~((x0 == y0) & (x1 - x0 == 1))
            parts.append(np.stack([x0, x1, y0, y1, level, err + add])[:, ok])
        new = np.concatenate(parts[::-1], axis=1)  # equal branches come off the stack first
        stack += [new[:, i : i + FRONTIER] for i in range(0, new.shape[1], FRONTIER)]
    return label


def _split(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where in each run the bit of this level turns from 0 to 1."""
    bit = np.uint64(1) << level.astype(np.uint64)
    return np.clip(np.searchsorted(key, (key[lo] & ~(bit - np.uint64(1))) | bit), lo, hi)


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        x, y = label[i], label[j]
        differ = x != y
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole groups; the rows come sorted, and the last group waits for the next batch."""
    def links(t: np.ndarray) -> pa.RecordBatch:
        key, tail, fp = t
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        label = trie_links(group, tail.astype(np.uint32))
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], ["a", "b"])

    whole: list[np.ndarray] = []  # of complete groups
    last: list[np.ndarray] = []  # of the group that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        t = np.stack([batch.column(c).to_numpy() for c in ("k", "tail", "fp")])
        cut = int(np.searchsorted(t[0], t[0][-1]))
        if cut or (last and last[-1][0, -1] != t[0, 0]):
            whole += [*last, t[:, :cut]]
            last = []
        last.append(t[:, cut:])
        if sum(x.shape[1] for x in whole) >= 1 << 16:
            yield links(np.concatenate(whole, axis=1))
            whole = []
    if whole or last:
        yield links(np.concatenate([*whole, *last], axis=1))


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints that link to another one; root is the smallest."""
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    tries = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        head = F.shiftleft(F.lit(t).cast("long"), 32) + F.shiftleft(block[i], 16) + block[j]
        tries.append(F.struct(head.alias("k"), (F.shiftleft(block[k], 16) + block[m]).alias("tail")))
    dealt = (
        distinct.select("fp", F.explode(F.array(*tries)).alias("x"))
        .select(F.col("x.k").alias("k"), F.col("x.tail").alias("tail"), "fp")
        .repartition("k")
        .sortWithinPartitions("k", "tail")
    )
    links = dealt.mapInArrow(_walk, "a long, b long")
    return components(links).select(F.col("node").alias("fp"), "root")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id of the component, the document itself included.
    Null text counts as empty, and an empty text has fingerprint 0 and is linked like any other.
    Rows without a doc_id belong to components like others but never name one: component_id is
    null if no row of the component has a doc_id. Repeated rows are repeated in the result, an
    empty table gives an empty result, and other columns of the input are not looked at. Whole
    texts are read, of any length; components have no ties, as ids that are equal name one alike.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    linked = nodes.join(fingerprint_components(nodes.select("fp")), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(linked.select("fp", "root").join(named, "root").select("fp", "component_id"), "simhash-classes")
    discard(nodes)
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
