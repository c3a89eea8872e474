"""Token counts of a piece model, from counts of distinct pre-tokens.

A piece model of this kind writes each space as a mark, puts one mark before a text, and has no
piece with a mark after another character. So no merge reaches from one word into the marks before
the next, and a text's count is the sum over its pre-tokens, each a run of spaces and the word
after it. In each batch the pre-tokens are cut and made distinct by Arrow, pieces are counted once
for each distinct one (and kept, bounded, by the worker for later batches), and the counts are
joined back to the documents' pre-tokens and summed. No ids of documents are made and nothing is
shuffled: a join over the whole corpus would move a row for each word of each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, spans_of_chars, text_runs

BATCH_CHARS = 1 << 20
#: Pre-tokens that a worker keeps counts of; longer ones (of texts without blanks) are counted each time.
CACHE_WORDS, CACHED_CHARS = 150_000, 32
MARK = "▁"


@cache
def model(path: str):
    import sentencepiece

    held = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in held.id_to_piece(i).lstrip(MARK) for i in range(held.get_piece_size())):
        raise ValueError(f"{path} has pieces across words; pre-tokens can't be counted apart")
    return held


@cache
def _known(path: str) -> dict[str, int]:
    return {"": 1}  # a mark alone


def pre_token_counts(distinct: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token, given without the first of its spaces."""
    known = _known(path)
    if len(known) > CACHE_WORDS:
        known.clear()
        known[""] = 1
    new = [x for x in distinct if x not in known]
    found = dict(zip(new, map(len, model(path).encode(new, num_threads=1)), strict=True)) if new else {}
    counts = np.fromiter((found[x] if x in found else known[x] for x in distinct), np.int64, len(distinct))
    known.update((x, n) for x, n in found.items() if len(x) <= CACHED_CHARS)
    return counts


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text; one task's share of the documents at a time."""
    texts = pc.replace_substring(texts.cast(pa.large_string()), MARK, " ")  # the model writes both alike
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int64)
    for lo, hi in spans_of_chars(lengths.tolist(), BATCH_CHARS):
        part = texts.slice(lo, hi - lo)
        odd = np.flatnonzero(pc.match_substring_regex(part, "^ |  ").to_numpy(zero_copy_only=False))
        words = pc.split_pattern(part, " ")
        if len(odd):  # runs of spaces belong to the word after them
            lists = words.to_pylist()
            for i in odd:
                lists[i] = [x[1:] for x in re.findall(" +[^ ]*", f" {part[i].as_py()}")]
            words = pa.array(lists, pa.large_list(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        each = pre_token_counts(coded.dictionary.to_pylist(), path)[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]
        total = np.r_[0, np.cumsum(each)]
        out[lo:hi] = total[ends[1:]] - total[ends[:-1]]
    return np.where(lengths == 0, 0, out)


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a piece model on every machine; no begin, end or added special tokens. Null and
    empty texts have no tokens; rows without a doc_id, repeated rows and other columns do no harm;
    an empty table gives an empty result. Whole texts, of any length.
    """
    d = id_and_text(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(count_tokens(text, path))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = d.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
