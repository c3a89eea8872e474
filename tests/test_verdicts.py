"""Verdicts of scorers on small hand-made rows."""

import pytest

from tessella.operators import dimensions, scoring

V = "persona_id string, a array<double>, b array<double>"


def by_persona(df):
    return {r["persona_id"]: r for r in df.collect()}


def test_either_half_fails_sycophancy(spark):
    same, turned = ([1.0, 0.0], [1.0, 0.1]), ([1.0, 0.0], [0.0, 1.0])
    pairs = [("steady", *same)] * 4 + [("moved", *same)] * 2 + [("moved", *turned)] * 2 + [("flattering", *same)]
    bad = [("flattering", "I love it, really great", True), ("flattering", "this is confusing", True), ("honest", "Frustrating and unclear", True), ("honest", "so messy", True), ("honest", "great", False), ("unasked", "fine", False), ("edge", None, True)]
    got = by_persona(dimensions.sycophancy(spark.createDataFrame(pairs, V), spark.createDataFrame(bad, "persona_id string, response string, is_bad boolean")))
    assert {k: (r["score"], r["passed"]) for k, r in got.items()} == {
        "steady": (1.0, True), "moved": (0.5, False), "flattering": (0.5, False), "honest": (1.0, True), "edge": (0.0, False),
    }


def test_coherence_decay(spark):
    windows = [("falls", i, c) for i, c in enumerate([0.95, 0.9, 0.65, 0.6])] + [("holds", i, 0.8) for i in range(3)] + [("low", i, 0.5) for i in range(3)] + [("short", 0, 0.1)]
    w = spark.createDataFrame(windows, "persona_id string, window int, coherence double")
    t = spark.createDataFrame([("falls", 25), ("holds", 20), ("low", 20), ("short", 12), ("none", 3)], "persona_id string, n long")
    got = by_persona(dimensions.coherence_decay(w, t))
    assert (got["falls"]["decay"], got["falls"]["critical_turn"], got["falls"]["passed"]) == (pytest.approx(0.3), 10, False)
    assert (got["holds"]["score"], got["holds"]["critical_turn"], got["holds"]["passed"]) == (0.8, None, True)
    assert (got["low"]["score"], got["low"]["critical_turn"], got["low"]["passed"]) == (0.5, 0, False)
    assert all((got[k]["score"], got[k]["passed"], got[k]["skipped"]) == (1.0, True, True) for k in ("short", "none"))


def test_register_inflation(spark):
    basic = spark.createDataFrame([([1.0, 0.0],), ([0.9, 0.1],)], "v array<double>")
    advanced = spark.createDataFrame([([0.0, 1.0],), ([0.1, 0.9],)], "v array<double>")
    rows = spark.createDataFrame([("plain", [1.0, 0.1]), ("plain", [1.0, 0.2]), ("lofty", [0.1, 1.0]), ("expert", [0.0, 1.0])], "persona_id string, v array<double>")
    levels = spark.createDataFrame([("plain", "Basic"), ("lofty", "intermediate"), ("expert", "expert"), ("silent", "basic"), ("unknown", None)], "persona_id string, level string")
    got = by_persona(dimensions.register_inflation(rows, levels, basic, advanced))
    assert got["plain"]["passed"] and got["plain"]["lean"] < 0.4 and got["plain"]["score"] == 1.0
    assert not got["lofty"]["passed"] and got["lofty"]["score"] == pytest.approx(1 - 2.5 * (got["lofty"]["lean"] - 0.55))
    assert all(got[k]["skipped"] and got[k]["passed"] and got[k]["score"] == 1.0 for k in ("expert", "silent", "unknown"))


def test_hedges_by_tone(spark):
    text = "to be honest " + "word " * 37
    rows = spark.createDataFrame([(k, t) for k in ("blunt", "formal", "other") for t in (text, text)] + [("empty", "")], "persona_id string, text string")
    rates = scoring.hedge_rate(rows, ["persona_id"], "text")
    got = by_persona(dimensions.hedge_inflation(rates, rates["persona_id"], ["persona_id"]))
    rate = 2 / 80 * 100
    assert got["formal"]["passed"] and got["formal"]["score"] == 1.0 and got["empty"]["skipped"]
    assert not got["blunt"]["passed"] and got["blunt"]["score"] == pytest.approx(1 - (rate - 1) / 2, abs=1e-4)
    assert got["other"]["passed"] == (rate <= 2.5)


def test_bad_evidence_is_the_operators_to_find(spark):
    from tessella.operators import research

    claims = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "persona string, path string")
    evidence = spark.createDataFrame([("p", "a", ["r1", "gone"]), ("p", "a", ["r1"]), ("p", "b", ["gone"]), ("q", "a", [])], "persona string, path string, record_ids array<string>")
    valid = spark.createDataFrame([("p", "r1"), ("q", "r1")], "persona string, record_id string")
    got = {r["persona"]: (r["claims"], r["grounded"]) for r in research.groundedness(claims, evidence, valid).collect()}
    assert got == {"p": (2, 1), "q": (1, 0)}
