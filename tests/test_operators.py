"""Operators on small hand-made inputs: the cases that the tables don't hold."""

import datetime
import types

import pytest
from pyspark.sql import functions as F

from tessella.functions import sets, stats, text
from tessella.operators import agreement, claims, dimensions, ingest, overlap, research, scoring, segment, summaries
from tessella.streaming import events as stream


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_jaccard_of_empty_sets_is_a_choice(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, sets.jaccard(empty, empty)) == 0.0
    assert one(spark, sets.jaccard(empty, empty, 1.0)) == 1.0
    assert one(spark, sets.jaccard(some, F.array(F.lit("b")))) == 0.5
    assert one(spark, sets.absorption(empty, some)) is None


def test_slugs(spark):
    assert one(spark, text.slug(F.lit("  Hé llo--World! "))) == "h-llo-world"
    assert one(spark, text.unicode_slug(F.lit("Hé llo"))) == "hé-llo"
    assert one(spark, text.slug(F.lit("!!"))) == "unknown"
    assert one(spark, text.none_if_blank(F.lit("  "))) is None


def test_topic_needs_a_space_on_both_sides(spark):
    assert one(spark, text.tags(F.lit("We like AI, and the data plan"))) == ["topic_data"]
    assert one(spark, text.tags(F.lit("an ai model"))) == ["topic_ai"]


def test_bots(spark):
    assert one(spark, text.is_bot(F.lit("Ann has joined the channel")))
    assert one(spark, text.is_bot(F.lit("READ THE RULES BEFORE POSTING HERE")))
    assert not one(spark, text.is_bot(F.lit("API SDK")))


def test_pearson_is_zero_without_spread(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    assert d.agg(stats.pearson0(F.col("x"), F.col("y")).alias("r")).first()["r"] == 0.0
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert d.agg(stats.pearson0(F.col("x"), F.col("y")).alias("r")).first()["r"] == pytest.approx(1.0)


def test_mode_prefers_the_first_seen(spark):
    d = spark.createDataFrame([("u", "b", 1), ("u", "a", 2), ("u", "a", 3), ("u", "b", 4), ("u", None, 0)], "u string, v string, seq int")
    assert segment.modes(d, ["u"], "v").first()["mode"] == "b"


def test_schema_roles(spark):
    payload = [{"zip": str(10000 + i), "score": str(i % 7 + 0.5), "plan": "ab"[i % 2], "note": f"n{i}", "rare": "x" if i < 2 else None} for i in range(12)]
    d = spark.createDataFrame([(p,) for p in payload], "payload map<string,string>")
    roles = {r["key"]: r["role"] for r in segment.infer_schema(d).collect()}
    assert roles == {"zip": "id", "score": "numeric", "plan": "categorical", "note": "skip", "rare": "skip"}


def test_empty_user_is_anonymous(spark):
    d = spark.createDataFrame([("r1", "", 1), ("r2", None, 2), ("r3", "u", 3)], "record_id string, user_id string, seq int")
    assert {r["k"] for r in d.select(segment.user_key().alias("k")).collect()} == {"anon_r1", "anon_r2", "u"}


def test_greedy_clusters(spark):
    users = [("t", "a", ["x", "y"], [], 1), ("t", "b", ["x", "y"], [], 2), ("t", "c", ["z"], [], 3), ("t", "d", ["z"], [], 4), ("t", "e", [], [], 5)]
    d = spark.createDataFrame(users, "tenant_id string, user_id string, behaviors array<string>, pages array<string>, seq long")
    got = {}
    for r in segment.cluster_users(d, "jaccard", 0.5).collect():
        got.setdefault(r["cluster"], set()).add(r["user_id"])
    assert sorted(got.values(), key=min) == [{"a", "b"}, {"c", "d"}]
    with pytest.raises(ValueError):
        segment.cluster_users(d, "other")


class PlainJaccard:
    def start(self, row):
        return set(row.behaviors)

    def add(self, row, c):
        c |= set(row.behaviors)

    def __call__(self, row, c):
        a = set(row.behaviors)
        return len(a & c) / len(a | c) if a or c else 0.0


@pytest.mark.parametrize("metric", ["jaccard", "gower"])
def test_clusters_in_rounds_are_those_of_all_users_at_once(spark, monkeypatch, metric):
    """Tenants of many users, of few and of one; no task may have more users than about a round's."""
    import random

    r = random.Random(4)
    users = []
    for tenant, n in (("hot", 160), ("small", 9), ("one", 1)):
        for i in range(n):
            behaviors = r.sample("abcdefghij", r.randint(0, 5))
            numeric = {k: r.random() for k in "xy" if r.random() < 0.6}
            categorical = {k: r.choice("pqr") for k in "cd" if r.random() < 0.6}
            users.append((tenant, f"{tenant}{i}", behaviors, r.sample("uvw", r.randint(0, 2)), r.randint(0, 10**6), numeric or None, categorical or None))
    threshold, want = (0.4 if metric == "jaccard" else 0.6), set()
    for tenant in ("hot", "small", "one"):
        mine = [u for u in users if u[0] == tenant]
        size = lambda u: len(u[2]) + (len(u[5] or {}) + len(u[6] or {}) if metric == "gower" else 0)
        mine.sort(key=lambda u: (-size(u), u[4]))
        seen = {k: [u[5][k] for u in mine if k in (u[5] or {})] for k in "xy"}
        rule = PlainJaccard() if metric == "jaccard" else segment._Gower({k: max(v) - min(v) for k, v in seen.items() if v})
        clusters, members = [], []
        for _, name, behaviors, pages, _, numeric, categorical in mine:
            row = types.SimpleNamespace(behaviors=behaviors, pages=pages, numeric=numeric or {}, categorical=categorical or {})
            s = [rule(row, c) for c in clusters]
            best = s.index(max(s)) if s and max(s) > 0 and max(s) >= threshold else len(clusters)
            if best == len(clusters):
                clusters.append(rule.start(row))
                members.append([])
            else:
                rule.add(row, clusters[best])
            members[best].append(name)
        want |= {(tenant, i, name) for i, m in enumerate(members) if len(m) > 1 for name in m}
    cols = "tenant_id string, user_id string, behaviors array<string>, pages array<string>, seq long, numeric map<string,double>, categorical map<string,string>"
    d = spark.createDataFrame(users, cols).repartition(5)
    monkeypatch.setattr(segment, "ROUND_USERS", 40)
    largest = segment._in_rounds(d.withColumn("order", F.lit(0))).groupBy("tenant_id", "round").count().agg(F.max("count")).first()[0]
    assert largest <= 80
    assert {tuple(x) for x in segment.cluster_users(d, metric, threshold).collect()} == want
    assert segment.cluster_users(d.where("false"), metric, threshold).count() == 0


def test_gower_without_shared_features_is_one(spark):
    d = spark.createDataFrame([(1, 2.0, "x"), (2, None, None)], "id int, n double, c string")
    g = segment.gower_distance("a", "b", {"n": 4.0}, ["c"], [])
    got = d.alias("a").join(d.alias("b"), F.col("a.id") < F.col("b.id")).select(g.alias("g")).first()["g"]
    assert got == 1.0


def test_policy(spark):
    t = spark.createDataFrame(
        [("web", None, False), ("web", "owned", False), ("x", None, False), ("discord", None, True), ("linkedin", "public_permitted", True), ("none", None, False)],
        "platform string, basis string, wants_inference boolean",
    )
    got = [r["refused"] for r in ingest.policy_gate(t).collect()]
    assert sorted(got) == sorted(["collection blocked", "", "collection blocked", "", "inference blocked", "unknown platform"])


def test_kappa_and_alpha(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (1, 1)], "a int, b int")
    assert agreement.cohen_kappa(d, "a", "b").first()["kappa"] == 1.0
    r = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y"), (3, "z")], "item int, v string")
    assert agreement.krippendorff_alpha(r, "item", "v").first()["alpha"] == 1.0


def test_suite_gates_by_tier(spark):
    cols = "persona_id int, name string, age int, experience_years int, education string, occupation string, marital_status string, income_bracket string"
    p = spark.createDataFrame([(1, "", 40, 5, "BSc", "Clerk", "", ""), (2, "Ann", 20, 19, "PhD", "CEO", "", "")], cols)
    got = {(r["persona_id"], r["dimension_id"]): (r["passed"], r["score"]) for r in scoring.suite([scoring.schema_compliance, scoring.demographic_coherence], p).collect()}
    assert got["1", "D1"] == (False, pytest.approx(0.8)) and got["1", "D7"] == (False, 0.0)
    assert got["2", "D1"] == (True, 1.0) and got["2", "D7"] == (False, pytest.approx(0.4))


def test_groundedness(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "persona int, path string")
    ev = spark.createDataFrame([(1, "a", ["r1"]), (1, "b", ["r1", "bad"]), (2, "a", ["r2"])], "persona int, path string, record_ids array<string>")
    valid = spark.createDataFrame([(1, "r1"), (2, "r2")], "persona int, record_id string")
    got = {r["persona"]: r["score"] for r in research.groundedness(claims, ev, valid).collect()}
    assert got == {1: 0.5, 2: 1.0}


def test_mean_pairwise_cosine_is_that_of_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(7, 4))
    d = spark.createDataFrame([(1, r.tolist()) for r in x], "g int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(7) for j in range(i)])
    assert scoring.mean_pairwise_cosine(d, ["g"], "v").first()["mean_cosine"] == pytest.approx(want)


@pytest.mark.parametrize("part", [dimensions.PART_VECTORS, 16])
def test_near_pairs_are_those_of_all_pairs(spark, monkeypatch, part):
    """Planted pairs about the bound, copies, scaled copies, and vectors that are near to nothing."""
    import numpy as np

    monkeypatch.setattr(dimensions, "PART_VECTORS", part)
    r = np.random.default_rng(2)
    x = r.normal(size=(150, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(u)
    for v, far in zip(u[:90], [0.01, 0.03, 0.045, 0.0499, 0.0501, 0.06] * 15, strict=True):
        w = r.normal(size=64)
        w -= w @ v * v
        w /= np.linalg.norm(w)
        c = 1 - far
        rows.append(c * v + np.sqrt(1 - c * c) * w)
    rows += [u[100]] * 40 + [3 * u[101], np.zeros(64), np.zeros(64), np.full(64, np.nan), np.full(64, 1e-8), np.full(64, 1e-8)]
    g = np.array(rows)
    n = np.sqrt((g * g).sum(axis=1))
    want = int(np.triu(1 - g @ g.T / (n[:, None] * n + 1e-10) < 0.05, 1).sum())
    assert want >= 60 + 820 + 1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(-1, None)], "persona_id long, v array<double>")
    assert dimensions.near_pairs(d, 0.05).first()["near_duplicates"] == want
    d = d.where("persona_id < 240")
    got = dimensions.distinctiveness(d).first()
    assert got["near_duplicates"] == 60 and not got["passed"]
    assert dimensions.near_pairs(d.where("false"), 0.05).first()["near_duplicates"] == 0


def test_streaming_windows_equal_batch(spark, small, tmp_path):
    """The tumbling job as a stream over files, against its batch run."""
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = (
        stream.tumbling(stream.read_stream(spark, str(tmp_path / "in")), "1 hour", "60 days")
        .writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.awaitTermination()
    key = lambda d: sorted((r["start"], r["event_type"], r["n"]) for r in d.collect())
    assert key(spark.table("tumbled")) == key(stream.tumbling(e, "1 hour"))


def test_sessions_close_after_the_gap(spark):
    t = datetime.datetime(2024, 1, 1)
    at = [t, t + datetime.timedelta(minutes=5), t + datetime.timedelta(hours=2)]
    d = spark.createDataFrame([(1, x) for x in at], "user_id int, ts timestamp")
    assert sorted(r["n"] for r in stream.sessions(d, "30 minutes").collect()) == [1, 2]


# Scorers by the cases of their rules.


def by_persona(df, *columns):
    return {r["persona_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_emotional_regulation(spark):
    said = {"joy": "I am happy and excited", "fear": "I am scared", "sadness": "so sad", "neutral": "let us think"}
    turns = [(p, i, said[e]) for p, es in {1: ["joy", "joy", "joy", "sadness", "fear"], 2: ["neutral"] * 4, 3: ["joy", "fear", "sadness", "neutral"], 4: ["fear", "joy"], 5: ["joy"] * 9 + ["fear"]}.items() for i, e in enumerate(es)]
    moods = [(1, "Optimistic but realistic"), (2, "calm"), (3, "calm"), (4, "nervous"), (5, "melancholy")]
    d = dimensions.emotional_regulation(spark.createDataFrame(turns, "persona_id int, turn int, text string"), spark.createDataFrame(moods, "persona_id int, mood string"))
    got = by_persona(d, "dominant", "aligned", "score", "passed")
    # of the words that a mood holds the first in the list counts: realistic comes before optimistic
    assert got[1] == ("joy", False, pytest.approx(0.2), False)
    assert got[2] == ("neutral", True, 1.0, True)
    assert got[3][2:] == (0.0, False)
    assert got[4] == ("fear", True, pytest.approx(0.2), False)
    assert got[5] == ("joy", False, pytest.approx(0.8), True)


def test_generation_bias(spark):
    levels = [(1, 0, 0.95), (1, 1, 0.9), (1, 2, 0.85), (2, 0, 0.9), (2, 1, 0.5), (2, 2, 0.2), (3, 0, 0.8), (3, 1, 0.6), (3, 2, 0.9), (4, 0, 0.5)]
    got = by_persona(dimensions.generation_bias(spark.createDataFrame(levels, "persona_id int, level int, v double"), "level", "v"), "drop", "score", "passed")
    assert got[1] == (pytest.approx(0.1), pytest.approx(0.9), True)
    assert got[2] == (pytest.approx(0.7), pytest.approx(1.6 / 3 - 0.1), False)
    assert got[3] == (0.0, pytest.approx(2.3 / 3), False)  # rises
    assert 4 not in got


def test_empathy_and_balanced_opinion(spark):
    r = [(1, "x", "I'm sorry, that sounds hard"), (1, "x", "Just deal with it"), (2, "x", "Obviously. Move on."), (3, None, "it depends"), (3, "", "both sides"), (3, "x", "No.")]
    d = spark.createDataFrame(r, "persona_id int, persona_opinion string, response string")
    assert by_persona(dimensions.empathy(d), "score", "passed") == {1: (0.5, True), 2: (0.0, False), 3: (0.0, False)}
    b = [(1, "x", "However you see it, it is also fine"), (1, "x", "I am for it"), (2, "x", "However, yes.\nAlso no"), (2, "x", "Pros and cons"), (2, "x", "It depends"), (3, "x", "no"), (3, None, "it depends")]
    got = by_persona(dimensions.balanced_opinion(spark.createDataFrame(b, "persona_id int, persona_opinion string, response string")), "score", "passed")
    assert got == {1: (0.5, False), 2: (pytest.approx(1 / 3), False)}


def test_refusals(spark):
    r = [(1, "I'm not sure, you'd want to ask someone", False), (1, "It is 42", False), (1, "Blue", True), (2, "Blue", True)]
    assert by_persona(dimensions.refusal_by_words(spark.createDataFrame(r, "persona_id int, response string, in_scope boolean")), "score", "passed") == {1: (0.5, True)}
    v = [(1, [1.0, 0.0], False), (1, [0.0, 1.0], False), (1, [0.0, 1.0], True), (1, [1.0, 0.1], True), (1, [0.2, 1.0], True), (2, [1.0, 0.0], True)]
    got = by_persona(dimensions.refusal(spark.createDataFrame(v, "persona_id int, v array<double>, in_scope boolean"), F.array(F.lit(1.0), F.lit(0.0))), "score", "passed")
    assert got == {1: (pytest.approx(3 / 5), True)}


def test_positivity_of_sets(spark):
    r = [("a", "happy and great and proud, one challenge"), ("a", "stressed and worried"), ("b", "nothing here"), ("c", "happy great amazing wonderful")]
    got = {x["g"]: (x["score"], x["passed"], x["skipped"]) for x in scoring.positivity(spark.createDataFrame(r, "g string, t string"), ["g"], "t").collect()}
    assert got["a"] == (pytest.approx(1.0), True, False) and got["b"] == (1.0, True, True) and got["c"][1] is False


def test_weird_bias_and_language_shift(spark):
    r = [(0, "self-reliance and personal achievement", "Austin, USA"), (0, "autonomy, meritocracy", "Berlin, Germany"), (1, "community and kinship", "Accra"), (1, "none", "Lima")]
    d = scoring.weird_bias(spark.createDataFrame(r, "g int, t string, place string"), ["g"], "t", "place")
    assert {x["g"]: (x["ratio"], x["score"], x["passed"]) for x in d.collect()} == {0: (1.0, 0.0, False), 1: (0.0, 1.0, True)}
    v = [("q", "en", [1.0, 0.0]), ("q", "fr", [0.0, 1.0]), ("r", "en", [1.0, 0.0])]
    x = scoring.language_shift(spark.createDataFrame(v, "question_id string, language string, v array<double>"), d.where("g = 1")).first()
    assert x["comparisons"] == 1 and x["score"] == pytest.approx(0.0) and x["passed"] is False
    same = scoring.language_shift(spark.createDataFrame(v[2:], "question_id string, language string, v array<double>"), d.where("g = 1")).first()
    assert same["passed"] is True and same["score"] == 1.0


def test_lists_must_be_lists(spark):
    p = spark.createDataFrame([(1, "n", 30, 3, ["g"], None, ["v"], ["k"], "text")], "persona_id int, name string, age int, experience_years int, goals array<string>, pain_points array<string>, values array<string>, knowledge_domains array<string>, behaviors string")
    x = scoring.schema_compliance(p).first()
    assert x["errors"] == ["pain_points", "behaviors"] and x["score"] == pytest.approx(0.6) and not x["passed"]


@pytest.mark.parametrize(
    ("dj", "dg", "cost", "ds", "n_ok", "verdict", "decision"),
    [
        (0.2, 0.0, 10.0, 0.0, 5, "MERGE", "MERGE"), (0.2, 0.0, 40.0, 0.0, 5, "MERGE-WITH-CAVEAT", "REVIEW"), (-0.12, 0.0, 0.0, 0.0, 5, "REJECT", "REVIEW"), (None, 0.06, 5.0, 0.0, 5, "MERGE", "MERGE"),
        (0.01, 0.01, 3.0, 0.0, 5, "NEUTRAL", "NEUTRAL"), (0.06, 0.0, 10.0, 0.0, 5, "REVIEW", "MERGE"), (0.0, 0.0, 0.0, -0.06, 5, "REJECT", "REJECT-RELIABILITY"), (0.5, 0.5, 0.0, 0.5, 0, "MERGE", "REJECT-BROKEN"), (0.0, 0.0, 60.0, 0.0, 5, "REJECT", "REVIEW"),
    ],
)
def test_verdicts(spark, dj, dg, cost, ds, n_ok, verdict, decision):
    d = spark.createDataFrame([(dj, dg, cost, ds, n_ok)], "dj double, dg double, c double, ds double, n int")
    x = d.select(research.verdict(F.col("dj"), F.col("dg"), F.col("c"), F.col("ds")).alias("v"), research.decision(F.col("dj"), F.col("dg"), F.col("c"), F.col("ds"), F.col("n")).alias("d")).first()
    assert (x["v"], x["d"]) == (verdict, decision)


def test_equal_implicit_sets_count_without_typed_features_only(spark):
    d = spark.createDataFrame([(1, 10.0, ["x"], ["p"]), (2, 20.0, ["x"], ["q"]), (3, None, ["x"], ["q"]), (4, None, ["x"], ["p"])], "i int, n double, behaviors array<string>, pages array<string>")
    g = segment.gower_distance("a", "b", {"n": 20.0}, [], [], implicit=("behaviors", "pages"))
    got = {(r["a"], r["b"]): r["g"] for r in d.alias("a").join(d.alias("b"), F.col("a.i") < F.col("b.i")).select(F.col("a.i").alias("a"), F.col("b.i").alias("b"), g.alias("g")).collect()}
    assert got[1, 2] == pytest.approx((0.5 + 1.0) / 2)  # equal behaviors say nothing beside numbers
    assert got[3, 4] == pytest.approx((0.0 + 1.0) / 2) and got[1, 4] == 0.0


# Claims, overlap, judges and the whole suite.


def test_domain_rules(spark):
    c = spark.createDataFrame([("p", "goals.0", "Cut the BUDGET and pass the audit"), ("p", "goals.1", "Be happy"), ("q", "pains.0", "Clinical costs")], "persona string, path string, text string")
    e = spark.createDataFrame([("p", "goals.0", ["a", "b", "a"]), ("q", "pains.0", ["a"])], "persona string, path string, record_ids array<string>")
    flagged = claims.domain_rules(c, e)
    got = {(r["persona"], r["path"]): (r["categories"], r["sources"], r["satisfied"]) for r in flagged.collect()}
    assert got == {("p", "goals.0"): (["financial", "legal"], 2, True), ("q", "pains.0"): (["financial", "medical"], 1, False)}
    rates = {r["persona"]: (r["claims"], r["sensitive"], r["financial"], r["rate"]) for r in claims.domain_summary(c, flagged).collect()}
    assert rates == {"p": (2, 1, 1, 0.5), "q": (1, 1, 1, 1.0)}


def test_verdicts_on_evidence(spark):
    e = spark.createDataFrame([("p", "a.0", 0.9), ("p", "a.1", 0.4), ("p", "a.2", 0.8), ("p", "a.3", None)], "persona string, path string, confidence double")
    v = spark.createDataFrame([("p", "a.0", "revise"), ("p", "a.1", "revise"), ("p", "a.2", "drop"), ("p", "a.3", "revise")], "persona string, path string, verdict string")
    assert {r["path"]: r["confidence"] for r in claims.apply_verdicts(e, v).collect()} == {"a.0": pytest.approx(0.7), "a.1": 0.3, "a.3": 0.3}


def test_semantic_overlap(spark):
    c = spark.createDataFrame([("p", "goals.0", "Reduce manual reporting, quickly!"), ("p", "goals.1", "Unrelated words entirely"), ("p", "goals.2", "nothing behind")], "persona string, path string, text string")
    e = spark.createDataFrame([("p", "goals.0", ["r1"]), ("p", "goals.1", ["r1"]), ("p", "goals.2", [])], "persona string, path string, record_ids array<string>")
    r = spark.createDataFrame([("p", "r1", "manual-reporting takes days; reduce it")], "persona string, record_id string, text string")
    o = claims.semantic_overlap(c, e, r)
    got = {x["path"]: (x["overlap"], x["semantic"], x["diverges"]) for x in o.collect()}
    assert got == {"goals.0": (0.75, True, False), "goals.1": (0.0, False, True)}  # "quickly!" keeps its mark
    s = claims.semantic_groundedness(c, o).first()
    assert (s["score"], s["backed"], s["weak"], s["coverage"]) == (0.375, 2, 1, pytest.approx(2 / 3))


def test_list_lengths(spark):
    d = spark.createDataFrame([(["a"], ["a", "b"], None), (["a", "b"], ["x"] * 9, ["a", "b", "c"])], "goals array<string>, pains array<string>, vocabulary array<string>")
    assert [r["e"] for r in d.select(claims.length_errors(d).alias("e")).collect()] == [["goals", "vocabulary"], ["pains"]]


def test_struct_similarity(spark):
    d = spark.createDataFrame([({"age": "30", "City": " Lyon "}, {"age": "30", "City": "lyon", "role": "x"}), ({}, {})], "a map<string,string>, b map<string,string>")
    assert [r["s"] for r in d.select(overlap.struct_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [pytest.approx(2 / 3), 0.0]


@pytest.mark.parametrize("level", ["nominal", "ordinal"])
def test_alpha_against_all_pairs(spark, level):
    import itertools
    import random

    r = random.Random(3)
    rows = [(i, r.randint(1, 5)) for i in range(30) for _ in range(r.randint(1, 4))]
    far = (lambda a, b: float(a != b)) if level == "nominal" else lambda a, b: float((a - b) ** 2)
    within = [far(a, b) for i in range(30) for a, b in itertools.combinations([v for k, v in rows if k == i], 2)]
    pooled = [far(a, b) for a, b in itertools.combinations([v for _, v in rows], 2)]
    got = agreement.krippendorff_alpha(spark.createDataFrame(rows, "item int, v int"), "item", "v", level=level).first()
    assert got["alpha"] == pytest.approx(1 - (sum(within) / len(within)) / (sum(pooled) / len(pooled)))


def test_preferences(spark):
    s = [("x-opus", "opus", 0.9, None), ("x-opus", "opus", 0.1, "timeout"), ("haiku", "opus", 0.5, None), ("sonnet", "opus", 0.7, None), ("haiku", "judge", 0.2, None)]
    d = agreement.preference_deltas(agreement.preference_matrix(spark.createDataFrame(s, "writer string, judge string, overall double, error string")))
    assert [(r["judge"], r["delta"]) for r in d.collect()] == [("opus", pytest.approx(0.3))]
    x = agreement.debias(d).first()
    assert x["bias"] == pytest.approx(0.3) and x["detected"]


def test_full_suite_closes_the_set_behind_a_failure(spark):
    p = spark.createDataFrame([(1, "a", 30, 3), (2, "", 30, 3)], "persona_id int, name string, age int, experience_years int")
    of_set = [scoring.set_result(spark.range(1).select(F.lit(True).alias("passed"), F.lit(0.9).alias("score")), "D6", "Distinctiveness", 2)]
    got = {(r["dimension_id"], r["persona_id"]): (r["passed"], r["score"], r["skipped"]) for r in scoring.suite_full([scoring.schema_compliance], of_set, p).collect()}
    assert got["D6", "__set__"] == (False, 0.0, True) and got["D1", "2"][0] is False
    ok = scoring.suite_full([scoring.schema_compliance], of_set, p.where("persona_id = 1"))
    assert {(r["dimension_id"]): r["passed"] for r in ok.collect()} == {"D1": True, "D6": True}
    assert [r["dimension_id"] for r in scoring.suite_full([scoring.schema_compliance], of_set, p, only_tier=2).collect()] == ["D6"]


def test_overlap_of_two_runs(spark):
    a = [("t", 0, "a"), ("t", 0, "b"), ("t", 1, "c"), ("t", 1, "d"), ("t", 1, "e"), ("u", 0, "x")]
    b = [("t", 5, "c"), ("t", 5, "a"), ("t", 5, "b"), ("t", 6, "d"), ("t", 7, "e"), ("t", 8, "f"), ("u", 1, "y")]
    members = "tenant_id string, cluster int, user_id string"
    got = {r["tenant_id"]: r["overlap"] for r in summaries.run_overlap(spark.createDataFrame(a, members), spark.createDataFrame(b, members)).collect()}
    # the first takes 5 with two users; the second has 5 taken, and one user in each of 6 and 7
    assert got == {"t": pytest.approx(3 / 6), "u": 0.0}


def test_sweep_of_settings(spark):
    rows = [("t", f"u{i}", list(b), [], i, 1) for i, b in enumerate(["ab", "ab", "abc", "xy", "xy", "q"])]
    users = spark.createDataFrame(rows, "tenant_id string, user_id string, behaviors array<string>, pages array<string>, seq int, n_records int")
    got = {(r["threshold"], r["min_size"]): (r["clusters"], r["noise"], r["mean_size"]) for r in summaries.sweep(users, [0.5, 1.0], [1, 2]).collect()}
    assert got == {(0.5, 1): (3, 0, 2.0), (0.5, 2): (2, 1, 2.5), (1.0, 1): (4, 0, 1.5), (1.0, 2): (2, 2, 2.0)}


def test_sample_takes_a_record_for_each_behavior_in_turn(spark):
    r = [("t", 0, f"r{i}", i, list(b)) for i, b in enumerate(["a", "ab", "b", "c", "a", "d", "a"])]
    pool = spark.createDataFrame(r, "tenant_id string, cluster int, record_id string, seq int, behaviors array<string>")
    top = summaries.top_values(pool, "behaviors")
    ids = lambda k: [x["record_id"] for x in summaries.representative_sample(pool, top, k).orderBy("rank").collect()]
    assert ids(5) == ["r0", "r1", "r3", "r5", "r2"] and ids(3) == ["r0", "r1", "r3"] and ids(7) == [f"r{i}" for i in range(7)]


def test_bots_are_left_out_unless_nothing_is_left(spark):
    r = [("t", 0, 1, {"m": "Ann has joined the channel"}), ("t", 0, 2, {"m": "hello"}), ("t", 1, 3, {"m": "[BOT] done", "n": "x"}), ("t", 1, 4, {})]
    d = spark.createDataFrame(r[:3], "tenant_id string, cluster int, seq int, payload map<string,string>")
    assert sorted(x["seq"] for x in summaries.without_bots(d).collect()) == [2, 3]
