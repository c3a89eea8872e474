"""Vectors in array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(TINY))


def unit(a: Column) -> Column:
    """The vector at length one; the length is worked out once, not for each element."""
    return F.zip_with(a, F.array_repeat(norm(a) + F.lit(TINY), F.size(a)), lambda x, n: x.cast("double") / n)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroids(df: DataFrame, by: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The mean vector of each group, with partial aggregation by place."""
    placed = df.select(*by, F.posexplode(vector).alias("i", "x"))
    mean = placed.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias(out)).withColumn(out, F.transform(out, lambda s: s["x"]))


#: Rows, and queries, that one task compares; queries in one product.
ROWS, QUERIES, PRODUCT = 8192, 4096, 256


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    x = lists.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def nearest(rows: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, digits: int | None = None, itself: bool = False) -> DataFrame:
    """(query, key, s, rank): for each query its ``k`` rows of greatest cosine, rounded to ``digits``; of equal ones those of
    smaller key; not the row of the query's own key, unless ``itself``.

    Every query is compared with every row by products of matrices. Runs of queries meet parts of the rows, so a
    task holds one of each however many there are, and yields the ``k`` best of its part."""
    runs, parts = (max(1, -(-d.count() // n)) for d, n in ((queries, QUERIES), (rows, ROWS)))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    # dealt before they are repeated: the same row has the same part in every run
    r = rows.where(F.col(vector).isNotNull()).select(dealt(parts).alias("__part"), F.size(vector).alias("__n"), F.col(key).alias("key"), F.col(vector).alias("v")).withColumn("__run", others(runs))
    q = queries.where(F.col(query_vector).isNotNull()).select(dealt(runs).alias("__run"), F.size(query_vector).alias("__n"), F.col(query).alias("query"), F.col(query_vector).alias("v")).withColumn("__part", others(parts))
    of_query, of_key = (d.schema[c].dataType.simpleString() for d, c in ((queries, query), (rows, key)))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):  # nothing meets
            return pa.table({"query": left["query"].slice(0, 0), "key": right["key"].slice(0, 0), "s": pa.array([], pa.float64())})
        right = right.sort_by("key")
        x, y = _matrix(left["v"]), _matrix(right["v"])
        lengths = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        own = right["key"].to_pylist() if not itself else []
        at = {v: i for i, v in enumerate(own)}
        found: list[tuple] = []
        for low in range(0, len(x), PRODUCT):
            s = x[low : low + PRODUCT] @ y.T / (lengths[0][low : low + PRODUCT, None] * lengths[1][None] + TINY)
            if digits is not None:
                s = np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits, s) + 0.0
            if not itself:
                for i, v in enumerate(left["query"].slice(low, PRODUCT).to_pylist()):
                    if v in at:
                        s[i, at[v]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            order = np.lexsort((j, -s[i, j], i))  # keys are in order
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[first] + low, j[first], s[i[first], j[first]]))
        i, j, s = (np.concatenate([f[n] for f in found]) for n in range(3))
        return pa.table({"query": left["query"].take(pa.array(i.astype(np.int64))), "key": right["key"].take(pa.array(j.astype(np.int64))), "s": pa.array(s.astype(np.float64))})

    by = ["__part", "__run", "__n"]
    d = q.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(best, f"query {of_query}, key {of_key}, s double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "key"))  # k rows for each part
    return d.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query), F.col("key").alias(key), "s", "rank")
