"""Comparing operators against plain versions."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.functions import ranks, stats
from tessella.operators import ablation, agreement_sets, evidence, segment, tournament
from tessella.plans import comparisons


def plain_ari(labels):
    """By counting pairs."""
    together = [(a == c, b == d) for (a, b), (c, d) in itertools.combinations(labels, 2)]
    n = Counter(together)
    both, only_a, only_b = n[True, True], n[True, False], n[False, True]
    total, pa, pb = len(together), both + only_a, both + only_b
    chance = pa * pb / total if total else 0
    most = (pa + pb) / 2
    return 1.0 if not total or most == chance else (both - chance) / (most - chance)


def test_adjusted_rand_counts_pairs(spark):
    r = random.Random(1)
    sets = [[(r.randrange(4), r.randrange(3)) for _ in range(n)] for n in (0, 1, 2, 5, 30, 60)] + [[(1, 1)] * 6, [(i, i) for i in range(6)], [(i % 2, i % 2 + 7) for i in range(9)]]
    d = spark.createDataFrame([(i, a, b) for i, s in enumerate(sets) for a, b in s] + [(0, None, 1)], "part int, a int, b int")
    got = {x["part"]: (x["n"], x["ari"]) for x in agreement_sets.adjusted_rand(d, "a", "b", ["part"]).collect()}
    assert got == {i: (len(s), pytest.approx(plain_ari(s), abs=1e-12)) for i, s in enumerate(sets) if s}
    (whole,) = agreement_sets.adjusted_rand(d.where("part = 4"), "a", "b").collect()
    assert whole["ari"] == pytest.approx(plain_ari(sets[4]))


def test_stability_and_two_methods(spark):
    """Three kinds of users that share nothing: every subsample and both measures find them."""
    rows = [("t", f"u{i:02}", i, [f"b{i % 3}{x}" for x in "abcd"], i) for i in range(45)]
    users = spark.createDataFrame(rows, "tenant_id string, user_id string, seq bigint, behaviors array<string>, first bigint")

    def by_kind(users):
        return users.select("tenant_id", "user_id", F.col("behaviors")[0].alias("cluster"))

    got = agreement_sets.stability(users, by_kind, runs=3).collect()
    assert [x["run"] for x in got] == [0, 1, 2] and all(x["ari"] == 1.0 and 20 < x["n"] < 45 for x in got)
    mixed = users.select("tenant_id", (F.col("seq") % 3).alias("a"), (F.col("seq") % 5).alias("b"))
    assert abs(agreement_sets.adjusted_rand(mixed, "a", "b").first()["ari"]) < 0.1


def plain_strengths(games, players, prior=0.5):
    """Coordinate-wise rounds in plain floats until nothing moves."""
    p = dict.fromkeys(players, 1.0)
    won, met = defaultdict(float), defaultdict(float)
    for a, b, w in games:
        met[a, b] += 1
        met[b, a] += 1
        won[a] += w
        won[b] += 1 - w
    for a, b in list(met):
        met[a, b] += 2 * prior
        won[a] += prior
    for _ in range(5000):
        move = 0.0
        for i in players:
            new = won[i] / sum(met[i, j] / (p[i] + p[j]) for j in players if (i, j) in met)
            move, p[i] = max(move, abs(new - p[i]) / p[i]), new
        mean = math.exp(sum(map(math.log, p.values())) / len(p))
        p = {k: v / mean for k, v in p.items()}
        if move < 1e-12:
            return p
    raise AssertionError


def test_strengths_are_those_of_a_plain_fit(spark, small):
    rows = comparisons.verdicts(spark, small).collect()
    got = defaultdict(dict)
    for r in comparisons.tournament_strengths(spark, small).collect():
        got[r["judge"]][r["persona"]] = r["strength"]
    for judge, own in got.items():
        games = []
        for r in rows:
            if r["judge"] == judge:
                turned = {"a": "b", "b": "a", "tie": "tie"}[r["second"]]
                winner = r["first"] if r["first"] == turned else "tie"
                games.append((r["a"], r["b"], {"a": 1.0, "b": 0.0, "tie": 0.5}[winner]))
        want = plain_strengths(games, sorted({x for g in games for x in g[:2]}))
        assert own == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}


def test_both_orders_are_needed_for_a_win(spark):
    rows = [("j", "d", "x", "y", f, s) for f in ("a", "b", "tie") for s in ("a", "b", "tie")]
    d = tournament.debiased(spark.createDataFrame(rows, "judge string, dimension string, a string, b string, first string, second string"))
    got = {(r["first"], r["second"]): (r["winner"], r["flipped"]) for r in d.collect()}
    tie = ("tie", False)
    assert got == {("a", "a"): ("tie", True), ("a", "b"): ("a", False), ("a", "tie"): tie, ("b", "a"): ("b", False), ("b", "b"): ("tie", True), ("b", "tie"): tie, ("tie", "a"): tie, ("tie", "b"): tie, ("tie", "tie"): tie}
    assert tournament.strengths(d.where("false").drop("winner", "flipped"), ["judge"]).count() == 0
    one = tournament.strengths(d.where("first = 'a' and second = 'b'").drop("winner", "flipped"), ["judge"]).collect()
    assert {r["persona"]: r["strength"] > 1 for r in one} == {"x": True, "y": False}  # one game, all finite


def test_running_sums_of_groups_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(g, v, r.randrange(5)) for g, n in (("hot", 900), ("b", 30), (None, 5)) for v in r.sample(range(10_000), n)]
    d = spark.createDataFrame(rows, "g string, v int, n bigint").repartition(5)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        got = ranks.running(d, ["g"], ["v"], "n").collect()
        at = ranks.positions(d, ["g"], ["v"]).collect()
    finally:
        spark.conf.unset(name)
    for x in got:
        own = [y for y in rows if y[0] == x["g"]]
        assert (x["before_n"], x["total_n"]) == (sum(n for _, v, n in own if v < x["v"]), sum(n for _, _, n in own))
    for g in ("hot", "b", None):
        assert [x["position"] for x in sorted((y for y in at if y["g"] == g), key=lambda y: y["v"])] == list(range(sum(y[0] == g for y in rows)))


def test_ks_against_a_normal_distribution(spark, small):
    o = [(r["o_orderpriority"], float(r["o_totalprice"])) for r in spark.read.parquet(f"{small}/orders.parquet").collect()]
    mean = sum(v for _, v in o) / len(o)
    std = math.sqrt(sum((v - mean) ** 2 for _, v in o) / len(o))
    cdf = lambda v: (1 + math.erf((v - mean) / std / math.sqrt(2))) / 2
    for r in comparisons.ks_against_normal(spark, small).collect():
        own = sorted(v for p, v in o if p == r["part"])
        n = len(own)
        want = max(max((i + 1) / n - cdf(v), cdf(v) - i / n) for i, v in enumerate(own))
        assert r["n"] == n and r["ks"] == pytest.approx(want, abs=1e-9)
        p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * n * want * want) for k in range(1, 200))
        assert r["p"] == pytest.approx(min(1, max(0, p)), abs=1e-6)


def test_ks_of_ties_and_empty_sides(spark):
    rows = [(1, 1.0, "x"), (1, 1.0, "y"), (1, 2.0, "y"), (1, None, "x"), (2, 5.0, "x"), (3, 1.0, "x"), (3, 1.0, "x"), (3, 4.0, "y"), (1, 9.0, "z")]
    got = {r["g"]: r["ks"] for r in stats.ks_two(spark.createDataFrame(rows, "g int, v double, s string"), "v", "s", ("x", "y"), ["g"]).collect()}
    assert got == {1: 0.5, 2: None, 3: 1.0}


def plain_judge(persona):
    def clean(f):
        return [x for x in persona.get(f) or [] if x.strip()]

    dims = []
    for specs in ablation.JUDGE.values():
        got = 0.0
        for f, w, cap in specs:  # one after another: sum() corrects itself
            got += w * min(len(clean(f)) / cap, 1.0)
        dims.append(round(1 + 4 * (got / sum(w for _, w, _ in specs)), 2))
    return round(sum(dims) / len(dims), 2), dims


def plain_spine(persona, collapse=2.0):
    current, left = dict(persona), [f for f in ablation.FIELDS if persona.get(f)]
    order, scores = [], []
    while left:
        score, field = max((plain_judge({**current, f: []})[0], f) for f in left)
        order.append(field)
        scores.append(score)
        current[field] = []
        left.remove(field)
        if score < collapse:
            break
    return order, scores, [f for f in ablation.FIELDS if current.get(f)]


def test_spines_are_those_of_a_plain_loop(spark, small):
    own = comparisons.field_personas(spark, small)
    personas = {r["persona_id"]: {f: r[f] for f in ablation.FIELDS} for r in own.collect()}
    spines = ablation.spine(own)
    got = {r["persona_id"]: r for r in spines.collect()}
    assert len(got) == len(personas) > 100
    orders = {}
    for k, p in personas.items():
        order, scores, spine = plain_spine(p)
        orders[k] = (order, spine)
        r = got[k]
        assert r["removal_order"] == order and r["scores"] == pytest.approx(scores, abs=1e-9) and r["spine"] == spine
        assert r["control"] == pytest.approx(plain_judge(p)[0]) and r["steps"] == len(order)
    for r in ablation.removal_ranking(spines).collect():
        at = [o.index(r["field"]) + 1 if r["field"] in o else len(o) + 1 for o, _ in orders.values()]
        assert r["mean_removal_step"] == pytest.approx(sum(at) / len(at))
        assert r["survival_rate"] == pytest.approx(sum(r["field"] in s for _, s in orders.values()) / len(orders))


def test_the_judge_rounds_as_plain_python(spark):
    r = random.Random(3)
    rows = [(i, *([x * "e" or " " for x in range(r.randrange(9))] if r.random() < 0.9 else None for _ in ablation.FIELDS)) for i in range(400)]
    d = spark.createDataFrame(rows, "persona_id int, " + ", ".join(f"{f} array<string>" for f in ablation.FIELDS))
    for x in ablation.judge(d).collect():
        overall, dims = plain_judge(dict(zip(ablation.FIELDS, rows[x["persona_id"]][1:], strict=True)))
        assert [x[k] for k in ablation.JUDGE] == pytest.approx(dims, abs=1e-9) and x["overall"] == pytest.approx(overall, abs=1e-9)


def test_swaps_take_others_of_the_cluster_without_repeats(spark):
    records = spark.createDataFrame([(1, f"r{i}") for i in range(7)] + [(2, "only")], "cluster int, record_id string")
    rows = [("p", 1, "goals.0", ["r1", "r2"]), ("p", 1, "pains.0", [f"r{i}" for i in range(5)]), ("p", 1, "summary", ["r0"]), ("q", 2, "goals.0", ["only"]), ("q", 2, "goals.1", ["gone"]), ("p", 1, "goals.9", [])]
    e = spark.createDataFrame(rows, "persona string, cluster int, path string, record_ids array<string>")
    seen = set()
    for r in evidence.swap_within(e, records, trials=6).collect():
        own = next(x[3] for x in rows if (x[0], x[2]) == (r["persona"], r["path"]))
        if (r["persona"], r["path"]) in {("p", "goals.0"), ("p", "pains.0"), ("q", "goals.1")}:
            assert r["swapped"] and not set(r["record_ids"]) & set(own) and len(set(r["record_ids"])) == len(r["record_ids"])
            assert len(r["record_ids"]) == {"goals.0": 2, "pains.0": 2, "goals.1": 1}[r["path"]]  # as many as there are others
            seen.add(tuple(r["record_ids"]))
        else:
            assert not r["swapped"] and r["record_ids"] == own
    assert len(seen) > 4  # trials differ
    claims = e.select("persona", "path").where("path <> 'goals.9'")
    got = {r["persona"]: (r["swapped"], r["passes"], r["false_pass_rate"]) for r in evidence.false_passes(claims, e.where("path <> 'goals.9'"), records, trials=6).collect()}
    assert got == {"p": (12, 6, 1.0), "q": (6, 6, 1.0)}  # every swap goes unseen


def test_clusterings_of_two_metrics_agree(spark):
    """Both metrics on the same users, compared as partitions."""
    rows = [(f"u{i:02}", i, [f"b{i % 2}{x}" for x in "abc"]) for i in range(20)]
    users = spark.createDataFrame([("t", u, [], b, [], {}, i, i) for u, i, b in rows], "tenant_id string, user_id string, record_ids array<string>, behaviors array<string>, pages array<string>, numbers map<string,double>, seq bigint, order bigint")
    a = segment.cluster_users(users, "jaccard", 0.5, 2).select("user_id", F.col("cluster").alias("a"))
    assert agreement_sets.adjusted_rand(a.join(users.select("user_id", (F.col("seq") % 2).alias("b")), "user_id"), "a", "b").first()["ari"] == 1.0


def test_swaps_by_arcs_equal_the_ring_and_entries_stay_apart(spark):
    """Rings of one arc and of several; two entries of one path are swapped each on its own."""
    sizes = {1: 1, 2: 5, 3: 16, 4: 33, 5: 70}
    records = [(c, f"{c}-{i}") for c, n in sizes.items() for i in range(n)]
    rows = [(f"p{c}", c, f"goals.{i // 2}", [f"{c}-{(i * 5 + j) % n}" for j in range(2)]) for c, n in sizes.items() for i in range(16)]
    d = spark.createDataFrame(records, "cluster int, record_id string")
    rings = {c: [x["record_id"] for x in sorted(evidence.ring(d, 42).where(f"cluster = {c}").collect(), key=lambda x: x["position"])] for c in sizes}
    want = Counter()
    for trial in range(3):
        for persona, c, path, ids in rows:
            ring, own = rings[c], set(ids)
            at = int(hashlib.md5(f"42:{trial}:{persona}:{path}".encode()).hexdigest()[:8], 16) % len(ring)
            look = [ring[(at + i) % len(ring)] for i in range(min(len(ring), 2 + len(own)))]
            new = [x for x in look if x not in own][:2]
            want[trial, persona, path, tuple(new or ids), bool(new)] += 1
    e = spark.createDataFrame(rows, "persona string, cluster int, path string, record_ids array<string>")
    assert Counter((x["trial"], x["persona"], x["path"], tuple(x["record_ids"]), x["swapped"]) for x in evidence.swap_within(e, d, trials=3).collect()) == want


def test_ids_that_stay_are_looked_up(spark):
    """A claim whose ids stay is grounded if a cluster of its persona has them all, in each trial alike."""
    records = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "cluster int, record_id string")
    rows = [("p", 1, "summary.0", ["a", "c"]), ("p", 2, "summary.1", ["c"]), ("q", 1, "summary.0", ["c"]), ("q", 1, "summary.1", []), ("q", 1, "summary.2", ["b"])]
    e = spark.createDataFrame([*rows, rows[1]], "persona string, cluster int, path string, record_ids array<string>")
    claims = spark.createDataFrame([(p, path) for p, _, path, _ in rows] + [("r", "summary.0")], "persona string, path string")
    got = {r["persona"]: (r["trials"], r["swapped"], r["passes"], r["false_pass_rate"]) for r in evidence.false_passes(claims, e, records, trials=2).collect()}
    assert got == {"p": (2, 0, 2, 1.0), "q": (2, 0, 0, 0.0), "r": (2, 0, 0, 0.0)}
