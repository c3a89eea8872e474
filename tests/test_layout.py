"""Cosines and layouts against plain ones."""

import math
import random

import numpy as np
import pytest

from tessella.operators import layout
from tessella.plans import comparisons


def table(spark, vectors):
    return spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "doc int, token string, w double")


def some_vectors(n, seed=1):
    r = random.Random(seed)
    out = {}
    for i in range(n):
        own = {f"k{i % 5}_{r.randrange(12)}": r.random() for _ in range(8)} | {f"c{r.randrange(6)}": 0.4 * r.random() for _ in range(3)}
        out[i] = own
    return out


def cosine(v, w):
    return sum(v[t] * w[t] for t in v if t in w) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_no_pair_is_lost(spark, threshold):
    v = some_vectors(60)
    v[60], v[61] = dict(v[3]), {"alone": 2.0}
    got = {(r["a"], r["b"]): r["cosine"] for r in layout.cosine_pairs(layout.unit(table(spark, v), "doc", "token"), "doc", "token", threshold).collect()}
    want = {(a, b): c for a in v for b in v if a < b and (c := cosine(v[a], v[b])) >= threshold}
    assert got == {k: pytest.approx(c, abs=1e-9) for k, c in want.items()} and (3, 60) in got


def stress(points, far):
    return sum((math.dist(points[a], points[b]) - far[a][b]) ** 2 for a in range(len(far)) for b in range(a))


def plain_layout(far, rounds=500):
    """Every point pulled and pushed by all others, again and again."""
    r = random.Random(42)
    at = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in far]
    for _ in range(rounds):
        for i in range(len(far)):
            fx = fy = 0.0
            for j in range(len(far)):
                if i != j:
                    dx, dy = at[i][0] - at[j][0], at[i][1] - at[j][1]
                    d = math.hypot(dx, dy) + 1e-9
                    fx -= (d - far[i][j]) / d * dx * 0.01
                    fy -= (d - far[i][j]) / d * dy * 0.01
            at[i] = at[i][0] + fx, at[i][1] + fy
    return at


@pytest.mark.parametrize("landmarks", [200, 25])
def test_stress_is_as_low_as_a_plain_one(spark, landmarks):
    v = some_vectors(40, seed=3)
    far = [[1 - cosine(v[a], v[b]) if a != b else 0.0 for b in v] for a in v]
    d = layout.layout(layout.unit(table(spark, v), "doc", "token"), "doc", "token", landmarks)
    at = [(r["x"], r["y"]) for r in sorted(d.collect())]
    limit = 1.05 if landmarks >= 40 else 1.25  # the others are placed by some of the distances only
    assert stress(at, far) <= limit * stress(plain_layout(far), far)
    s = layout.spread(d, "doc").first()
    pairs = [math.dist(at[a], at[b]) for a in range(40) for b in range(a)]
    assert s["points"] == 40 and s["spread"] == pytest.approx(sum(pairs) / len(pairs))


def test_small_layouts(spark):
    one = layout.layout(layout.unit(table(spark, {1: {"a": 1.0}}), "doc", "token"), "doc", "token").collect()
    assert [(r["doc"], r["x"], r["y"]) for r in one] == [(1, 0.0, 0.0)]
    two = layout.layout(layout.unit(table(spark, {1: {"a": 1.0}, 2: {"b": 1.0}}), "doc", "token"), "doc", "token").collect()
    assert math.dist(*[(r["x"], r["y"]) for r in two]) == pytest.approx(1.0, abs=1e-6)
    assert layout.layout(layout.unit(table(spark, {}), "doc", "token"), "doc", "token").count() == 0


def test_layout_of_items(spark, small):
    got = comparisons.tfidf_layout(spark, small).collect()
    assert len(got) == spark.read.parquet(f"{small}/benchmark.parquet").count() and np.isfinite([[r["x"], r["y"]] for r in got]).all()
