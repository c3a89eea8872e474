"""Cosine similarity of sparse vectors, and a layout of them in the plane.

Pairs: a vector's tokens are ordered by rarity, and it is looked up under the first of them only, up to
where what is left is shorter than the threshold: two vectors as near as that share one of these
tokens on both sides, so none is lost, and the common tokens, which all have, bring no pairs together.

Layout: a bounded number of vectors, drawn by hash, are landmarks. Their distances to each other are
laid out by stress majorization; every other vector is then placed by its distances to the landmarks
alone, each row for itself. So no matrix of all distances is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are laid out together, and rounds of majorization.
LANDMARKS, ROUNDS = 200, 300
SLACK = 1e-9


def unit(weights: DataFrame, doc: str, token: str, w: str = "w") -> DataFrame:
    """(doc, token, w) at length one; vectors of length 0 go."""
    norm = weights.groupBy(doc).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm")).where("norm > 0")
    return weights.join(norm, doc).where(F.col(w) != 0).select(doc, token, (F.col(w) / F.col("norm")).alias("w"))


def cosine_pairs(vectors: DataFrame, doc: str, token: str, threshold: float) -> DataFrame:
    """(a, b, cosine) of all pairs of unit vectors (nonnegative weights) whose cosine is ``threshold`` (above 0)
    or more, a < b."""
    df = vectors.groupBy(token).agg(F.count("*").alias("df"))
    rare = Window.partitionBy(doc).orderBy(F.desc("df"), F.desc(token)).rowsBetween(Window.unboundedPreceding, 0)  # of one vector
    left = vectors.join(df, token).withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rare)))  # its own weight and that of all commoner
    prefix = left.where(F.col("rest") >= threshold - SLACK).select(doc, token)
    side = lambda name: prefix.select(F.col(doc).alias(name), token)
    met = side("a").join(side("b"), token).where("a < b").select("a", "b").distinct()
    x, y = (vectors.select(F.col(doc).alias(n), token, F.col("w").alias(f"w{n}")) for n in "ab")
    dot = met.join(x, "a").join(y, ["b", token]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return dot.where(F.col("cosine") >= threshold)


def majorize(distances: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Places whose distances come near the given ones, by Guttman's transform."""
    x, n = start - start.mean(axis=0), len(start)
    for _ in range(rounds):
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        b = -np.divide(distances, d, out=np.zeros_like(d), where=d > 1e-12)
        np.fill_diagonal(b, 0.0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / n
    return x


def _classical(distances: np.ndarray) -> np.ndarray:
    """A start: the two main axes of the doubly centred squares; the sign makes it one answer."""
    n = len(distances)
    c = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-0.5 * c @ (distances**2) @ c)
    axes = axes[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0.0))
    axes = np.pad(axes, ((0, 0), (0, 2 - axes.shape[1])))
    return axes * np.where(axes[np.abs(axes).argmax(axis=0), range(2)] < 0, -1, 1)


def place_by(landmarks: np.ndarray, distances: np.ndarray, rounds: int = 60) -> np.ndarray:
    """For each row of distances to the landmarks, where these are met best."""
    near = np.argmin(distances, axis=1)
    x = landmarks[near] * 0.999 + landmarks.mean(axis=0) * 0.001
    for _ in range(rounds):
        gap = x[:, None] - landmarks[None]
        d = np.maximum(np.linalg.norm(gap, axis=2, keepdims=True), 1e-12)
        x = (landmarks[None] + gap * (distances[:, :, None] / d)).mean(axis=1)
    return x


def layout(vectors: DataFrame, doc: str, token: str, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc, x, y) of unit vectors by their cosine distances."""
    docs = vectors.select(doc).distinct()
    drawn = [r[0] for r in docs.orderBy(F.xxhash64(doc), doc).limit(landmarks).collect()]  # the bound of the method
    kind = vectors.schema[doc].dataType
    marks = vectors.sparkSession.createDataFrame([(i, x) for i, x in enumerate(drawn)], f"mark int, m {kind.simpleString()}")
    own = vectors.join(F.broadcast(marks), vectors[doc] == F.col("m")).select("mark", token, F.col("w").alias("wm"))
    dots = vectors.join(own, token).groupBy(doc, "mark").agg(F.sum(F.col("w") * F.col("wm")).alias("dot"))
    n = len(drawn)
    # a row of distances for each vector; without a common token it is 1
    rows = docs.join(dots, doc, "left").groupBy(doc).agg(F.map_from_entries(F.collect_list(F.when(F.col("mark").isNotNull(), F.struct("mark", "dot")))).alias("dots"))  # landmarks at most
    far = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda i: F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_element_at("dots", i), F.lit(0.0))))
    rows = rows.select(doc, far.alias("far"))
    known = rows.join(F.broadcast(marks), F.col(doc) == F.col("m")).select("mark", "far").collect()
    matrix = np.array([r["far"] for r in sorted(known)]).reshape(n, n)
    matrix = (matrix + matrix.T) / 2
    np.fill_diagonal(matrix, 0.0)
    at = majorize(matrix, _classical(matrix)) if n > 1 else np.zeros((n, 2))
    held = vectors.sparkSession.sparkContext.broadcast((at, {x: i for i, x in enumerate(drawn)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            far = batch.column("far").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = place_by(at, far)
            for i, k in enumerate(batch.column(doc).to_pylist()):
                if k in index:
                    x[i] = at[index[k]]
            yield pa.RecordBatch.from_arrays([batch.column(doc), pa.array(x[:, 0]), pa.array(x[:, 1])], [doc, "x", "y"])

    return rows.mapInArrow(run, f"{doc} {kind.simpleString()}, x double, y double")


def spread(points: DataFrame, doc: str, landmarks: int = LANDMARKS) -> DataFrame:
    """One row: points, spread (the mean distance of two points; beyond ``landmarks`` points, of a point and one
    of so many drawn by hash)."""
    marks = points.orderBy(F.xxhash64(doc), doc).limit(landmarks).select(F.col(doc).alias("m"), F.col("x").alias("mx"), F.col("y").alias("my"))
    d = points.join(F.broadcast(marks), F.col(doc) != F.col("m"))  # landmarks at most a point
    far = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)
    return d.agg(F.count_distinct(doc).alias("points"), F.coalesce(F.avg(far), F.lit(0.0)).alias("spread"))
