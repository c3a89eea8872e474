"""Nearest vectors by parts, and bands of recency, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import vectors
from tessella.operators import research


def test_nearest_in_runs_and_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS", 7)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "PRODUCT", 2)
    x = np.random.default_rng(5).normal(size=(40, 4))
    x[10:25] = x[3]  # copies, which tie
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    d = vectors.nearest(e, "k", "v", e.where("k % 4 = 3").select(F.col("k").alias("q"), F.col("v").alias("w")), "q", "w", 3, digits=7)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(q, r + 1, j) for q in range(3, 40, 4) for r, j in enumerate(sorted((j for j in range(40) if j != q), key=lambda j: (-round(float(u[q] @ u[j]), 7), j))[:3])}
    assert {(r["q"], r["rank"], r["k"]) for r in d.collect()} == want
    # rows and queries meet by group, not one by one
    assert "NestedLoop" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [10, 70])
def test_recency_bands_in_whole_numbers(spark, n):
    d = spark.range(n).selectExpr("1 as u", "id", "timestamp_seconds(id) as at")
    r = research.recency(d, ["u"], "at", F.lit("2024-01-01").cast("timestamp"), 7.0, ["id"])
    got = {x["band"]: x["count"] for x in r.groupBy("band").count().collect()}
    assert got == {"high": n * 3 // 10, "medium": n * 4 // 10, "low": n * 3 // 10}
