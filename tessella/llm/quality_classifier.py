"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed features: its words, beginnings that several of its words share, the
graded shares of its tokens' shapes (case, symbols, punctuation), and a few more graded shares such
as repeated words and lines. One weight vector, shared by all grades, gives a score s, and ordered thresholds t_1 < t_2 < ... give
P(grade >= k) = sigmoid(s - t_k), so a grade's likelihood is the difference of two neighbours, and the
fit maximises it. Expected grade and tail probability follow and select documents. The fit reads a
bounded sample of rated documents, ``FIT_ROWS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, materialize, text_runs

BITS = 18
FIT_ROWS = 20_000
EPOCHS, BATCH, RATE, DECAY, SEED = 20, 64, 0.3, 1e-4, 7
#: Thresholds lie at least so far apart, and documents are featured in runs of so many characters.
LEAST_GAP, BATCH_CHARS = 0.05, 1 << 20
#: A feature counts only if this share of the sample's documents has it, and three of them, and if
#: their mean grade is so many standard errors away from that of all.
LEAST_SHARE, LEAST_Z = 0.001, 4.0
SHARES = (0.001, 0.01, 0.03, 0.1, 0.3, 0.6, 0.9)
_SYMBOLS, _DIGITS = frozenset("#$%&*|<>"), frozenset("0123456789")
_EDGES = re.compile(rb"^[^\w\x80-\xff]+|[^\w\x80-\xff]+$")


def _grade(x: float) -> int:
    return sum(x > s for s in SHARES)


#: What a token may be; a share of each among the tokens is a feature.
SHAPES = ("upper", "symbol", "bang", "stop", "digit", "bare")
#: A worker's table of tokens begins anew at so many, or at about so many bytes of them.
CACHE_TOKENS, CACHE_BYTES, ENTRY_BYTES = 300_000, 48 << 20, 120
#: Word beginnings of so many letters are features if so many words, and this share, have them.
STEMS, LEAST_STEMS, STEM_SHARE = (5, 6, 7), 2, 0.005


def _hash(name: bytes | str, seed: int = 0) -> int:
    return xxhash.xxh32_intdigest(name, seed) & ((1 << BITS) - 1)


class _Tokens(dict):
    """The row of each token in ``table``: its hashed word, its shapes as bits, and its hashed
    beginnings; bounded."""

    def __init__(self) -> None:
        self.table = np.zeros((CACHE_TOKENS, 2 + len(STEMS)), np.int32)
        self.new: list[tuple[int, ...]] = []
        self.bytes = 0

    def __missing__(self, token: bytes) -> int:
        self.bytes += len(token) + ENTRY_BYTES
        t = token.decode()
        if t.isalpha():
            w, shapes = t, 0
        elif t[-1] in ",." and t[:-1].isalpha():  # most others
            w, shapes = t[:-1], 8 * (t[-1] == ".")
        else:
            w = _EDGES.sub(b"", token).decode()
            marks = (not _SYMBOLS.isdisjoint(t), "!" in t, t[-1] in ".?;:", not _DIGITS.isdisjoint(t), not w)
            shapes = sum(x << i for i, x in enumerate(marks, 1))
        low = w.lower()
        shapes |= len(w) > 1 and w.isupper()
        n = len(low)
        self.new.append((_hash(low), shapes, *[_hash(low[:k], 1) if n >= k else -1 for k in STEMS]))
        self[token] = row = len(self)
        return row

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        """The table's rows of these tokens; a text's new tokens always find room."""
        if len(self) + len(tokens) > len(self.table) or self.bytes > CACHE_BYTES:
            self.clear()
            self.bytes = 0
            if len(tokens) > len(self.table):
                self.table = np.zeros((2 * len(tokens), self.table.shape[1]), np.int32)
        held = len(self)
        found = np.array([self[t] for t in tokens], np.int64)
        if self.new:
            self.table[held : held + len(self.new)] = self.new
            self.new = []
        return found


_TOKENS = _Tokens()


def features(text: str) -> np.ndarray:
    """Distinct hashed features of a whole text, sorted, int32."""
    tokens = text.encode().split()
    rows = _TOKENS.rows(tokens)
    n = max(len(rows), 1)
    distinct, times = np.unique(rows, return_counts=True)
    coded = _TOKENS.table[distinct]
    word = np.unique(coded[:, 0])
    graded = {k: int(times[(coded[:, 1] >> i & 1) == 1].sum()) / n for i, k in enumerate(SHAPES)}
    graded["same"] = int((rows[1:] == rows[:-1]).sum()) / n
    graded["distinct"] = len(word) / n
    graded["top"] = int(np.bincount(np.searchsorted(word, coded[:, 0]), times, len(word)).max(initial=0)) / n
    lines = [x for x in text.split("\n") if x.strip()]
    graded["lines"] = 1 - len(set(lines)) / max(len(lines), 1)
    names = [b"\x00%s=%d" % (k.encode(), _grade(v)) for k, v in graded.items()] + [b"\x00length=%d" % len(rows).bit_length()]
    # beginnings that many of the words share: the compounds and inflections of one stem
    stems = coded[:, 2:].ravel()
    stem, at = np.unique(stems[stems >= 0], return_inverse=True)
    often = np.bincount(at, np.repeat(times, len(STEMS))[stems >= 0], len(stem))
    common = stem[(often >= LEAST_STEMS) & (often >= STEM_SHARE * n)]
    return np.unique(np.r_[word, common, [_hash(x) for x in names]]).astype(np.int32)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]


def _scores(weights: np.ndarray, i: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's weights; a row may have none."""
    return np.diff(np.r_[0.0, np.cumsum(weights[i])][at])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """Weights of features and thresholds of grades 1, 2, ..."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for each row and k = 1, 2, ..."""
        i, at = _flat(rows)
        return _sigmoid(_scores(self.weights, i, at)[:, None] - self.thresholds)


def telling(seen: np.ndarray, grades: np.ndarray, n: int, mean: float, deviation: float) -> np.ndarray:
    """Which features are frequent enough and have a mean grade far enough from that of all: of n
    documents ``seen`` have each, with that sum of ``grades``."""
    z = np.abs(grades - mean * seen) / np.maximum(deviation * np.sqrt(seen), 1e-12)
    return (seen >= max(3, LEAST_SHARE * n)) & (z >= LEAST_Z)


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> Ordinal:
    """Maximise the cumulative-link likelihood, the sum of log(F(s - t_k) - F(s - t_(k+1))) over rows
    of grade k, less a small decay of weights, by AdaGrad; thresholds stay in order."""
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    t, gt = np.linspace(-1.0, 1.0, max(levels - 1, 1))[: levels - 1], np.full(levels - 1, 1e-6)
    random = np.random.default_rng(SEED)
    for _ in range(EPOCHS if rows else 0):
        order = random.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            i, at = _flat([rows[j] for j in pick])
            y, all_rows = grades[pick], np.arange(len(pick))
            tails = _sigmoid(_scores(w, i, at)[:, None] - t)
            tails = np.concatenate([np.ones((len(pick), 1)), tails, np.zeros((len(pick), 1))], axis=1)
            upper, lower = tails[all_rows, y], tails[all_rows, y + 1]
            chance = np.maximum(upper - lower, 1e-9)
            g = (upper + lower - 1) / len(pick)  # of -log(chance), by the score
            of, where = np.unique(i, return_inverse=True)
            step = np.bincount(where, np.repeat(g, np.diff(at)), len(of)) + DECAY * w[of]
            gw[of] += step**2
            w[of] -= RATE * step / np.sqrt(gw[of])
            step = np.bincount(y, upper * (1 - upper) / chance, levels + 1) - np.bincount(y + 1, lower * (1 - lower) / chance, levels + 1)
            step = step[1:levels] / len(pick)  # by the thresholds
            gt += step**2
            gaps = LEAST_GAP * np.arange(levels - 1)
            t = np.maximum.accumulate(t - RATE * step / np.sqrt(gt) - gaps) + gaps
    return Ordinal(w, t)


def fit(docs: DataFrame, ratings: DataFrame, levels: int, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", grade_col: str = "grade") -> Ordinal:
    """Fit on ratings (id, grade 0 .. levels - 1) of documents.

    At most about ``fit_rows`` ratings are used, drawn by a hash of the id. Ratings without id or
    grade are ignored; of several for one document the least counts; repeated rows of a rated
    document count each. Which features tell grades apart is counted in Spark, and the driver
    gets those alone. Without ratings all weights are zero."""
    rated = ratings.select(F.col(id_col).alias("doc_id"), F.col(grade_col).cast("int").alias("grade")).dropna()
    rated = rated.where(F.col("grade").between(0, levels - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    drawn = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, fit_rows / max(n, 1)))
    d = id_and_text(docs, id_col).join(F.broadcast(drawn), "doc_id")  # fit_rows rows of two numbers

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("grade"), pa.array(x, pa.binary())], ["doc_id", "grade", "x"])

    table = materialize(d.mapInArrow(featured, "doc_id string, grade int, x binary"), "classifier-features")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for batch in batches:
            if batch.num_rows:
                i, at = _flat([np.frombuffer(x, np.int32) for x in batch.column("x").to_pylist()])
                seen += np.bincount(i, minlength=1 << BITS)
                total += np.bincount(i, np.repeat(batch.column("grade").to_numpy().astype(float), np.diff(at)), 1 << BITS)
        has = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(seen[has]), pa.array(total[has])], ["i", "seen", "total"])

    of_all = table.agg(F.count("*").alias("n"), F.mean("grade").alias("mean"), F.stddev_pop("grade").alias("deviation")).first()
    seen, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
    sums = table.mapInArrow(counted, "i bigint, seen double, total double").groupBy("i").agg(F.sum("seen"), F.sum("total"))
    for i, x, y in sums.collect():  # 2 to the BITS rows at most
        seen[i], total[i] = x, y
    usable = telling(seen, total, of_all["n"], of_all["mean"] or 0.0, of_all["deviation"] or 0.0)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [(y := np.frombuffer(x, np.int32))[usable[y]].tobytes() for x in batch.column("x").to_pylist()]
            yield batch.set_column(2, "x", pa.array(x, pa.binary()))

    found = table.mapInArrow(reduced, "doc_id string, grade int, x binary").toPandas().sort_values(["doc_id", "grade", "x"])
    discard(table)
    return fit_ordinal([np.frombuffer(x, np.int32) for x in found["x"]], found["grade"].to_numpy(), levels)


def classify(docs: DataFrame, model: Ordinal, good: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, expected_grade, tails array<double> (P(grade >= 1), P(grade >= 2),
    ...), p_good = P(grade >= good), selected (p_good >= least).

    Null and empty texts are rated by their length feature like others; rows without a doc_id and
    repeated rows are rated like others; a text just at ``least`` is selected; an empty table gives
    an empty result; other columns are not looked at. Whole texts are read.
    """
    d = id_and_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 to the BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, BATCH_CHARS):
            texts = batch.column("text").to_pylist()
            tails = held.value.tails([features(t) for t in texts]) if texts else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails.tolist(), pa.list_(pa.float64()))], ["doc_id", "expected_grade", "tails"]
            )

    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>")
    return out.withColumn("p_good", F.get("tails", F.lit(good - 1))).withColumn("selected", F.col("p_good") >= least)


#: Grades of the ``labels`` table: 0 toxic, 1 of low quality, 2 neither.
LABEL_LEVELS = 3


def label_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of 0/1 labels for quality and toxicity; null if either is null and the other
    doesn't settle it."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNull(), F.lit(None)).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"),
    )
