"""Language identification by nearest centroid.

A text is a vector of hashed character n-grams (of 1 to 3 letters; everything else is a blank),
sublinear counts times inverse document frequency, at length one. Document frequencies come from
all documents that are learned from. Each language has several centroids, clustered by cosine in a
bounded sample of its documents, so that a language may hold several kinds of text. A text gets the
language of the nearest centroid; one that is farther from it than nearly all of the language's own
texts of about its length is rejected.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from .common import spans_of_chars, text_or_empty, text_runs

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Distinct texts of a language that its centroids are fitted on at most (drawn by hash).
FIT_DOCUMENTS = 500
#: A text is rejected below this share of the least cosine in its language's sample.
REJECT_SHARE = 0.5
#: Texts of under 64 letters say too little for that and have a fixed least cosine.
SURE_CLASS, LEAST_COSINE = 6, 0.02
#: Characters and texts that are counted at once: a text takes ``DIMENSIONS`` numbers, however short.
BATCH_CHARS, BATCH_ROWS = 1 << 19, 256
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Each code point that is a letter, and a blank for every other."""
    return np.fromiter((i if chr(i).isalpha() else 32 for i in range(sys.maxunicode + 1)), np.uint32)


def gram_counts(texts: list[str], dimensions: int = DIMENSIONS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of the texts: counts of hashed n-grams, a row for each text, and their letters."""
    low = [t.lower() for t in texts]
    for lo, hi in spans_of_chars([len(t) for t in low], BATCH_CHARS, BATCH_ROWS):
        part = low[lo:hi]
        cp = _letters()[np.frombuffer("  ".join(["", *part, ""]).encode("utf-32-le"), np.uint32)].astype(np.int64)
        row = np.repeat(np.arange(len(part)), [len(t) + 2 for t in part])
        c = cp[1:]  # from the second of the blanks before the first text
        n = len(row)
        a, b, d = c[:n], c[1 : n + 1], np.r_[c, 32, 32][2 : n + 2]
        one = (a * 0x9E3779B1) >> 7
        two = (one ^ (b * 0x85EBCA77)) * 0x27D4EB2F >> 9
        three = (two ^ (d * 0xC2B2AE3D)) * 0x165667B1 >> 11
        size = len(part) * dimensions
        inner = np.ones(n, bool)  # the blank after a text opens no n-gram: it would reach the next text
        inner[np.cumsum([len(t) + 2 for t in part]) - 1] = False
        letter = a != 32
        pair = (letter | (b != 32)) & inner
        triple = (letter | (b != 32) | (d != 32)) & inner
        out = np.zeros(size, np.int64)
        for h, ok in ((one, letter), (two, pair), (three, triple)):
            out += np.bincount((row * dimensions + (h & (dimensions - 1)))[ok], minlength=size)
        yield out.reshape(len(part), dimensions), np.bincount(row[letter], minlength=len(part))


def vectors(texts: list[str], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for counts, letters in gram_counts(texts, len(idf)):
        x = np.log1p(counts).astype(np.float32) * idf
        yield x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), letters


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by cosine, from starts far apart; the same for any order of rows."""
    x = x[np.lexsort(x.T[:3])]
    mean = x.mean(axis=0)
    centers = [x[np.argmax(x @ mean)]]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[np.argmin(np.max(x @ np.stack(centers).T, axis=1))])
    c = np.stack(centers)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 12)


class Centroids:
    """What is learned: centroids (a row each) with their language, idf, and for each language and
    class of length the cosine below which a text is rejected."""

    def __init__(self, idf: np.ndarray, centers: np.ndarray, langs: list[str], least: dict[str, list[float]]) -> None:
        self.idf, self.centers, self.langs, self.least = idf, centers, langs, least

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the text is rejected, of each text."""
        langs, score, rejected = [], [], []
        for x, letters in vectors(texts, self.idf):
            if not len(self.langs):
                near, best = None, np.zeros(len(x))
            else:
                cos = x @ self.centers.T
                near, best = np.argmax(np.round(cos, 6), axis=1), np.clip(cos.max(axis=1), 0.0, 1.0)  # equal but for rounding: the first
            for i, n in enumerate(letters):
                lang = self.langs[near[i]] if n and near is not None else UNKNOWN
                langs.append(lang)
                s = float(best[i]) if lang != UNKNOWN else 0.0
                score.append(s)
                rejected.append(lang == UNKNOWN or s < self.least[lang][length_class(n)])
        return langs, np.array(score), np.array(rejected, bool)


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", fit_documents: int = FIT_DOCUMENTS) -> Centroids:
    """Learn from the rows where ``learn`` holds and the language is not null.

    Document frequencies are counted over all of them; only the clustering reads a sample: of each
    language the ``fit_documents`` distinct texts with the smallest hashes (all, where there are
    fewer), however often each comes. Null languages and null, empty or letterless texts teach nothing;
    ids aren't looked at, and neither are other columns; without a row to learn from, the model
    knows no language and calls every text ``und``.
    """
    d = docs.where(learn & F.col(lang_col).isNotNull() & (F.length(F.col(text_col)) > 0))
    d = d.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, by = np.zeros(DIMENSIONS, np.int64), {}
        for batch in text_runs(batches, BATCH_CHARS, BATCH_ROWS):
            for x in batch.column("lang").to_pylist():
                by[x] = by.get(x, 0) + 1
            for counts, _ in gram_counts(batch.column("text").to_pylist()):
                df += (counts > 0).sum(axis=0)
        rows = [(None, i, int(n)) for i, n in enumerate(df) if n] + [(k, -1, n) for k, n in by.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64())], ["lang", "i", "n"])

    # a row for each dimension and each language
    found = d.mapInArrow(frequencies, "lang string, i bigint, n bigint").groupBy("lang", "i").agg(F.sum("n").alias("n")).collect()
    by = {r["lang"]: r["n"] for r in found if r["i"] == -1}
    total, df = sum(by.values()), np.zeros(DIMENSIONS)
    for r in found:
        if r["i"] >= 0:
            df[r["i"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    if not by:
        return Centroids(idf, np.zeros((0, DIMENSIONS), np.float32), [], {})

    # distinct hashes alone are ranked, in each task first; then the texts of those drawn are fetched
    hashed = d.withColumn("h", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h")
    low = hashed.select("lang", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit_documents)
    low = docs.sparkSession.createDataFrame(low.select("lang", "h").collect(), "lang string, h bigint")  # so many for each language at most
    drawn = hashed.join(F.broadcast(low), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def to_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS, BATCH_ROWS):
            x = [(v.tobytes(), int(n)) for part, letters in vectors(batch.column("text").to_pylist(), idf) for v, n in zip(part, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([v for v, _ in x], pa.binary()), pa.array([n for _, n in x], pa.int64())], ["lang", "v", "letters"])

    def centroids(group):
        import pandas as pd

        x = np.stack([np.frombuffer(v, np.float32) for v in group["v"]])
        ok = group["letters"].to_numpy() > 0
        if not ok.any():
            return pd.DataFrame({"lang": [], "v": [], "least": []})
        c = cluster(x[ok])
        best, kind = (x[ok] @ c.T).max(axis=1), length_class(group["letters"].to_numpy()[ok])
        # a class of length can't ask for more than a longer one
        least = [float(min([1.0, *best[kind >= i]]) if (kind >= i).any() else best.min()) for i in range(13)]
        least = [REJECT_SHARE * min([*best[(kind <= i) & (kind >= SURE_CLASS)], least[i]]) if i >= SURE_CLASS else LEAST_COSINE for i in range(13)]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "v": [r.tobytes() for r in c], "least": [least] * len(c)})

    fitted = drawn.mapInArrow(to_vectors, "lang string, v binary, letters bigint").groupBy("lang").applyInPandas(centroids, "lang string, v binary, least array<double>").collect()
    fitted.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    centers = np.stack([np.frombuffer(bytes(r["v"]), np.float32) for r in fitted]) if fitted else np.zeros((0, DIMENSIONS), np.float32)
    return Centroids(idf, centers, [r["lang"] for r in fitted], {r["lang"]: list(r["least"]) for r in fitted})


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into this fold; a row without an id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced.

    Texts that are null, empty or without a letter are ``und``, score 0, rejected. A text at the
    same distance from two languages gets the first by name. Nothing but the text is looked at.
    Rows without an id, repeated rows, further columns and empty tables do no harm.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMENSIONS numbers
    new = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS, BATCH_ROWS, "__text"):
            langs, score, rejected = held.value.predict(batch.column("__text").to_pylist())
            for name, x in zip(new, (pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)), strict=True):
                batch = batch.append_column(name, x)
            yield batch.select([*kept, *new])

    d = docs.select(*kept, text_or_empty(text_col).alias("__text"))
    out = StructType([f for f in docs.schema.fields if f.name in kept]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return d.mapInArrow(run, out)


def language_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected; learned from what isn't held out."""
    model = fit(docs, ~held_out())
    d = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(d, model).drop("text")
