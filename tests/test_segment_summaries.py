"""Clusters with their summaries and verbatim samples against plain versions."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import segment, summaries
from tessella.plans import summaries as plans


def mean_distances(signatures):
    return [sum(math.dist(x, y) for j, y in enumerate(signatures) if i != j) / max(1, len(signatures) - 1) for i, x in enumerate(signatures)]


def test_style_coherent_equals_all_pairs(spark):
    r = random.Random(1)
    rows = [(g, i, [r.random() if g != "same" else 0.5 for _ in range(8)]) for g, n in (("a", 40), ("b", 3), ("one", 1), ("same", 9)) for i in range(n)]
    rows += [("spread", i, [float(i % 2)] * 4 + [r.gauss(0, 5) for _ in range(4)]) for i in range(50)]
    d = spark.createDataFrame(rows, "g string, i int, s array<double>")
    for k in (1, 4, 8):
        got = defaultdict(list)
        for x in sorted(segment.style_coherent(d, ["g"], "i", "s", k).collect(), key=lambda x: x["rank"]):
            got[x["g"]].append(x["i"])
        for g in ("a", "b", "one", "same", "spread"):
            own = [s for h, _, s in rows if h == g]
            want = sorted((round(m, 9), i) for i, m in enumerate(mean_distances(own)))[:k]
            assert got[g] == [i for _, i in want]


def test_few_rows_are_compared_with_all(spark, monkeypatch):
    """Of a group round one style most can't be among the nearest."""
    r = random.Random(2)
    rows = [("g", i, [r.gauss(0, 0.01 if i < 20 else 1.0) for _ in range(8)]) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, i int, s array<double>")
    got = {x["i"] for x in segment.style_coherent(d, ["g"], "i", "s", 4).collect()}
    assert got == {i for _, i in sorted((m, i) for i, m in enumerate(mean_distances([s for _, _, s in rows])))[:4]}


def test_verbatim_samples(spark, small):
    of_cluster, _ = plans._clustered(spark, small)
    c = summaries.verbatim_candidates(of_cluster).withColumn("s", text.style_signature(F.col("t"))).collect()
    own = defaultdict(list)
    for x in sorted(c, key=lambda x: (x["seq"], x["at"])):
        own[x["tenant_id"], x["cluster"]].append((x["t"], list(x["s"])))
    got = defaultdict(list)
    for x in sorted(plans.verbatim_samples(spark, small).collect(), key=lambda x: x["position"]):
        got[x["tenant_id"], x["cluster"]].append(x["t"])
    assert set(got) == set(own) and got
    for k, texts in own.items():
        near = sorted((round(m, 9), i) for i, m in enumerate(mean_distances([s for _, s in texts])))[: summaries.VERBATIM]
        assert got[k] == [texts[i][0] for i in sorted(i for _, i in near)]
        assert all(20 <= len(t) <= 2000 for t in got[k])


def test_segment_summaries(spark, small):
    from tessella.plans import segmentation

    got = {(r["tenant_id"], r["cluster_id"]): r for r in plans.segment_summaries(spark, small).collect()}
    members = {(r["tenant_id"], r["cluster_id"]): r["members"].split(",") for r in segmentation.segment_jaccard(spark, small).collect()}
    assert {k: r["members"] for k, r in got.items()} == members
    records = plans._records(spark, small).collect()
    for (tenant, k), r in got.items():
        own = sorted((x for x in records if x["tenant_id"] == tenant and x["user_id"] in members[tenant, k]), key=lambda x: x["seq"])
        assert (r["cluster_size"], r["n_records"]) == (len(members[tenant, k]), len(own))
        first, n = {}, Counter(b for x in own for b in x["behaviors"])
        for at, b in enumerate(b for x in own for b in x["behaviors"]):
            first.setdefault(b, at)
        assert r["top_behaviors"] == sorted(n, key=lambda b: (-n[b], first[b]))[: summaries.TOP]
        assert dict(x.split(":") for x in r["sources"].split(",")) == {s: str(c) for s, c in Counter(x["source"] for x in own).items()}
        assert len(set(r["sample"])) == len(r["sample"]) == min(summaries.SAMPLE, len(own)) and set(r["sample"]) <= {x["record_id"] for x in own}
        assert len(r["verbatim"]) <= summaries.VERBATIM and set(r["verbatim"]) <= {v.strip() for x in own for v in x["payload"].values() if v}


def test_bots_are_found_as_by_the_patterns_alone(spark):
    """Whatever the case, behind other words or first; words of a pattern alone are no bots'."""
    bots = ["Ann HAS joined the Channel", "x pinned  a message", "Welcome to the subreddit!", "you've been Added to it", "see, this ROOM is for all", "a rule violation", "@AutoMod: no", "bot here", "an auto-reply", " [System] up", "hi @everyone", "\nFYI: x", " public service announcement", "[update] 2", "A" * 20]
    plain = ["she left", "pinned", "welcome home", "I have been there", "this is it", "law enforcement", "autonomous", "a [bot]x", "robot", "ann@work", "HELLO", "see fyi: x", "\u212a" * 3, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(bots + plain)] + [(99, None)], "i int, t string")
    got = {r["i"]: r["b"] for r in d.select("i", text.is_bot(F.col("t")).alias("b")).collect()}
    letters = F.length(F.regexp_replace("t", "[^\\p{L}]", ""))
    whole = F.col("t").rlike("(?i)" + "|".join(text.BOT_PATTERNS)) | ((letters >= 20) & (F.length(F.regexp_replace("t", "[^\\p{Lu}]", "")) >= 0.8 * letters))
    assert got == {r["i"]: r["b"] for r in d.select("i", whole.alias("b")).collect()}
    assert [i for i, b in got.items() if b] == list(range(len(bots)))


def test_texts_are_looked_at_once(spark, small):
    """What the results are made of is a table: their plans match no text again."""
    of_cluster, _ = plans._clustered(spark, small)
    for d in (summaries.without_bots(of_cluster), summaries.verbatim_samples(of_cluster)):
        assert "RLIKE" not in d._jdf.queryExecution().optimizedPlan().toString().upper()
