"""Ranked lexical search by Fagin's threshold algorithm.

All documents are ranked for each item of a query set by integer scores of the BM25 kind. The
forward index, written once, holds for each document the query terms that it has, how often, and its
length; the corpus counts come from it. A task then reads the index in shards of bounded size. In a
shard each term has its documents sorted by impact, and an item's lists are read round robin, a
stride at a time; documents that are new are looked up in the forward index for their whole score.
The reading stops when the threshold, the sum of the impacts that the lists have come to, is strictly
below the k-th best score so far (ties go by id, so an equal score may still come first). The k best
are carried from shard to shard of a task, which makes later shards stop early, and the tasks' best
are ranked at last: no list of all documents is ever formed, and no row for each pair of item and
document.

Items are read in blocks of bounded size, each of which is searched over all documents; a block's
terms are what is broadcast.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, spans_of_chars, text_or_empty, text_runs

TOP = 20
#: Items that are searched at once, and the bytes of their text: what a block's terms take is bounded.
BLOCK_ITEMS, BLOCK_BYTES = 2000, 8 << 20
#: Postings and documents of a shard.
SHARD_POSTINGS, SHARD_DOCUMENTS = 1 << 20, 1 << 15
#: Entries of each list that are read between two looks at the threshold, at first; then twice as many
#: each time, up to the second number.
STRIDE, WIDEST = 32, 1024
BATCH_BYTES = 1 << 20

#: Bytes to bytes: A-Z in lower case, what parts terms to blanks; all above ASCII belongs to terms.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def weights(n_documents: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_documents + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def length_norms(lengths: np.ndarray, n_documents: int, total_terms: int) -> np.ndarray:
    """m of documents of these many terms. Python's integers where the product might not fit."""
    if len(lengths) and int(lengths.max()) * 25 * n_documents >= 1 << 62:
        return np.array([75 + 25 * int(n) * n_documents // total_terms for n in lengths], np.int64)
    return 75 + 25 * lengths.astype(np.int64) * n_documents // max(total_terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Shard:
    """A part of the forward index with its impact-sorted lists. ``at`` are the bounds of each
    document's postings; terms are numbers, ascending within a document."""

    def __init__(self, at: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> None:
        self.documents, self.at, self.term = len(at) - 1, at, term
        doc = np.repeat(np.arange(self.documents), np.diff(at))
        self.impact = impacts(tf, m[doc]) * weight[term]
        order = np.lexsort((doc, -self.impact, term))
        self.list_doc, self.list_impact = doc[order], self.impact[order]
        self.list_at = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.times = np.zeros(len(weight), np.int64)  # of the terms of the item at hand

    def scores(self, docs: np.ndarray) -> np.ndarray:
        """Random access: whole scores of these documents."""
        first, size = self.at[docs], self.at[docs + 1] - self.at[docs]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        total = np.r_[0, np.cumsum(self.impact[place] * self.times[self.term[place]])]
        return total[ends] - total[ends - size]

    def search(self, query: np.ndarray, times: np.ndarray, best: list[tuple], k: int, name, read: dict | None = None) -> None:
        """Put this shard's best into ``best``, a heap of k at most: the score and what ``name(document)``
        gives, of which less is worse at the same score."""
        self.times[query] = times
        lo, hi = self.list_at[query], self.list_at[query + 1]
        seen = np.zeros(self.documents, bool)
        depth, stride, longest = 0, STRIDE, int((hi - lo).max(initial=0))
        while depth < longest:
            # sorted access, each list in turn
            new = [self.list_doc[a + depth : min(b, a + depth + stride)] for a, b in zip(lo, hi, strict=True) if a + depth < b]
            depth, stride = depth + stride, min(2 * stride, WIDEST)
            docs = np.unique(np.concatenate(new))
            docs = docs[~seen[docs]]
            seen[docs] = True
            if read is not None:
                read["documents"] = read.get("documents", 0) + len(docs)
            if len(docs):
                score = self.scores(docs)
                for i in np.flatnonzero(score >= (best[0][0] if len(best) == k else 1)):
                    entry = (int(score[i]), *name(int(docs[i])))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            # what the next entry of each list has; a list that is at its end has nothing more to give
            more = lo + depth < hi
            threshold = int((self.list_impact[(lo + depth)[more]] * times[more]).sum())
            if threshold == 0 or (len(best) == k and threshold < best[0][0]):
                break
        self.times[query] = 0


def forward_index(docs: DataFrame, number: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the text), terms array<int> ascending, tfs array<bigint>: of each document the
    numbered terms alone, but all documents that have a term."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    held = d.sparkSession.sparkContext.broadcast(number)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in text_runs(batches, BATCH_BYTES):
            lengths, own, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                all_terms = terms(text)
                found = sorted((known[t], n) for t, n in Counter(all_terms).items() if t in known)
                lengths.append(len(all_terms))
                own.append([t for t, _ in found])
                tfs.append([n for _, n in found])
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(own, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    return d.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tfs array<bigint>")


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Lists of (id, Counter of terms), in no order, of bounded size; a longer text is a block of its own."""
    rows = items.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).toLocalIterator()
    block, held = [], 0
    for r in rows:
        block.append((r["i"], Counter(terms(r["t"]))))
        held += len(r["t"])
        if len(block) == BLOCK_ITEMS or held > BLOCK_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents with bounded postings: ids, n, bounds, terms, tfs."""
    held, postings, rows = [], 0, 0

    def joined():
        t = pa.Table.from_batches(held).combine_chunks()
        size = pc.list_value_length(t["terms"]).to_numpy()
        flat = lambda c: pc.list_flatten(t[c]).to_numpy()
        return t["doc_id"], t["n"].to_numpy(), np.r_[0, np.cumsum(size)].astype(np.int64), flat("terms").astype(np.int64), flat("tfs")

    for batch in batches:
        sizes = pc.list_value_length(batch.column("terms")).to_pylist()
        for lo, hi in spans_of_chars(sizes, SHARD_POSTINGS, SHARD_DOCUMENTS):
            held.append(batch.slice(lo, hi - lo))
            rows += hi - lo
            postings += sum(sizes[lo:hi])
            if postings >= SHARD_POSTINGS or rows >= SHARD_DOCUMENTS:
                yield joined()
                held, postings, rows = [], 0, 0
    if rows:
        yield joined()


class _Falling:
    """An id whose order is turned round, null last, so that a heap drops the largest id first."""

    __slots__ = ("value",)

    def __init__(self, value) -> None:
        self.value = value

    def __lt__(self, other: _Falling) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value

    def __gt__(self, other: _Falling) -> bool:
        return other < self

    def __eq__(self, other) -> bool:
        return self.value == other.value


def search_block(index: DataFrame, block: list[tuple], number: dict[bytes, int], k: int) -> DataFrame:
    """(item: its place in the block, doc_id, score): the k best of each task for each item."""
    counts = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(number), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    n_documents, total = counts["docs"], counts["terms"] or 1
    weight = weights(n_documents, df)
    queries = [(np.array([number[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for _, c in block]
    held = index.sparkSession.sparkContext.broadcast((weight, queries))
    schema = pa.schema([("item", pa.int32()), pa.field("doc_id", _arrow_type(index)), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = held.value
        best: list[list[tuple]] = [[] for _ in queries]
        for ids, n, at, term, tf in _shards(batches):
            if not len(term):
                continue
            shard = Shard(at, term, tf, length_norms(n, n_documents, total), weight)
            name = lambda i: (_Falling(ids[i].as_py()),)  # noqa: B023, E731
            for (query, times), own in zip(queries, best, strict=True):
                if len(query):
                    shard.search(query, times, own, k, name)
        rows = [(i, e[1].value, e[0]) for i, own in enumerate(best) for e in own]
        for a in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + (1 << 16)], strict=True), schema.types, strict=True)], schema=schema)

    return index.mapInArrow(run, f"item int, doc_id {index.schema['doc_id'].dataType.simpleString()}, score bigint")


def _arrow_type(index: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(index.schema["doc_id"].dataType)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the highest score above 0, equal scores
    by ascending id.

    Every row of ``items`` is an item of its own, whose repeated terms count each time, and every row
    of ``docs`` a document: rows with one id or one text are ranked beside each other, a row without an
    id behind those with one at the same score. Null, empty and letterless texts have no terms, are no
    documents for the counts and give no rows; texts of any length are read whole; further columns
    aren't looked at; an empty table on either side gives an empty result.
    """
    spark, out = docs.sparkSession, None
    ids = items.schema[item_id].dataType
    for block in item_blocks(items, item_id, text_col):
        number = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
        index = materialize(forward_index(docs, number, doc_id, text_col), "search-index")
        best = materialize(search_block(index, block, number, k), "search-best")
        discard(index)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {ids.simpleString()}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # BLOCK_ITEMS rows at most
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {ids.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score bigint")
    return out
