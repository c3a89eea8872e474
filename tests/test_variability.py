"""Edges of the variability operators."""

import pytest

from tessella.operators import variability as v


def one(df):
    (r,) = df.collect()
    return r


def test_variation_of_zeros_and_nulls(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 0.0), ("b", "y", None)], "persona_id string, dimension string, score double")
    got = {(r["level"], r["name"]): (r["n"], r["cv"]) for r in v.variation(d).collect()}
    assert got == {("all", ""): (3, pytest.approx(0.9354143)), ("persona", "a"): (2, 0.5), ("persona", "b"): (1, 0.0), ("dimension", "x"): (2, 1.0), ("dimension", "y"): (1, 0.0)}


def test_retest_picks_the_steadier_setting(spark):
    d = spark.createDataFrame([("t0", "x", 3.0), ("t0", "y", 4.0), ("t5", "x", 1.0), ("t5", "y", 5.0), ("t5", "y", None)], "setting string, dimension string, score double")
    r = one(v.more_reliable(d))
    assert (r["setting"], r["deviation"]) == ("t0", 0.5)
    assert {(x["setting"], x["dimension"]) for x in v.retest(d).collect()} == {(s, k) for s in ("t0", "t5") for k in ("x", "y", None)}


def test_entailment_without_valid_evidence(spark):
    d = spark.createDataFrame([("p", "neutral", False, 0.5), ("p", None, None, None), ("q", "entailed", True, 1.0), ("q", "contradicted", True, 0.0)], "persona_id string, label string, grounded boolean, confidence double")
    got = {r["persona_id"]: r for r in v.entailment(d).collect()}
    assert (got["p"]["coverage"], got["p"]["false_positive_rate"], got["p"]["confidence"]) == (0.0, 0.0, 0.5)
    assert (got["q"]["entailed_rate"], got["q"]["false_positive_rate"]) == (0.5, 0.5)


def test_vocabularies_of_few_personas(spark):
    words = lambda rows: spark.createDataFrame(rows, "persona_id string, word string")
    r = one(v.vocabulary_overlap(words([])))
    assert (r["mean_jaccard"], r["unique_ratio"], r["total"]) == (0.0, 1.0, 0)
    r = one(v.vocabulary_overlap(words([("a", "x"), ("a", " X "), ("a", " ")])))
    assert (r["mean_jaccard"], r["unique_ratio"], r["total"], r["shared"]) == (0.0, 1.0, 1, 0)
    r = one(v.vocabulary_overlap(words([("a", "x"), ("a", "y"), ("b", "Y"), ("c", "z")])))
    assert (r["mean_jaccard"], r["unique_ratio"], r["shared"]) == (pytest.approx(0.5 / 3), pytest.approx(2 / 3), 1)
