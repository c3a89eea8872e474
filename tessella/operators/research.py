"""Research metrics: coverage, vocabulary, diversity, drift, deltas, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def best_coverage(records: DataFrame, personas: DataFrame, record: str, persona: str, token: str = "token", least: float = 0.05) -> DataFrame:
    """Each record's best persona by Jaccard of tokens, through an inverted index; records that share
    no token with any are uncovered with similarity 0. Both sides are (id, token), distinct."""
    nr, np_ = records.groupBy(record).agg(F.count("*").alias("nr")), personas.groupBy(persona).agg(F.count("*").alias("np"))
    shared = records.join(personas, token).groupBy(record, persona).agg(F.count("*").alias("s"))
    sim = shared.join(nr, record).join(np_, persona).withColumn("sim", F.col("s") / (F.col("nr") + F.col("np") - F.col("s")))
    best = sim.groupBy(record).agg(F.max_by(F.struct(persona, "sim"), F.struct("sim", -F.col(persona))).alias("x"))
    out = nr.join(best, record, "left").select(record, F.col(f"x.{persona}").alias(persona), F.coalesce("x.sim", F.lit(0.0)).alias("sim"))
    return out.withColumn("covered", F.col("sim") >= least)


def vocabulary_divergence(tokens: DataFrame, group: str, token: str = "token") -> DataFrame:
    """Jensen-Shannon divergence of the word distributions of each pair of groups (a < b)."""
    n = tokens.groupBy(group, token).agg(F.count("*").alias("n"))
    names = n.select(group).distinct()
    pairs = names.select(F.col(group).alias("a")).join(names.select(F.col(group).alias("b")), F.col("a") < F.col("b"))
    side = lambda c: pairs.join(n, F.col(c) == F.col(group)).select("a", "b", token, "n")
    return stats.jsd(side("a"), side("b"), token, ["a", "b"])


def axis_diversity(values: DataFrame, axis: str, value: str) -> DataFrame:
    """Per axis: distinct values, mode share, Gini of the shares, and whether it is collapsed or diverse."""
    c = values.where(F.col(value).isNotNull()).groupBy(axis, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(axis))
    d = c.withColumn("p", p).groupBy(axis).agg(F.count("*").alias("k"), F.max("p").alias("mode_share"), F.sum(F.col("p") * F.col("p")).alias("sq"))
    g = F.when(F.col("k") < 2, 1.0).otherwise(F.try_divide(F.col("sq") - 1 / F.col("k"), 1 - 1 / F.col("k")))
    return d.select(axis, "k", "mode_share", g.alias("gini"), F.when(F.col("mode_share") > 0.6, "collapsed").when(F.col("mode_share") < 0.4, "diverse").otherwise("mixed").alias("verdict"))


def tfidf(tokens: DataFrame, doc: str, token: str, n_docs: int) -> DataFrame:
    """(doc, token, w) with share of the document times ln((n + 1) / (df + 1)) + 1."""
    c = tokens.groupBy(doc, token).agg(F.count("*").alias("c"))
    total = tokens.groupBy(doc).agg(F.count("*").alias("total"))
    df = c.groupBy(token).agg(F.count("*").alias("df"))
    idf = F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1)) + 1
    return c.join(total, doc).join(df, token).select(doc, token, (F.col("c") / F.col("total") * idf).alias("w"))


def recency(df: DataFrame, by: list[str], at: str, now: Column, scale_days: float, order: list[str]) -> DataFrame:
    """exp(-age / scale), and the band of each row: the newest 30 % high, the oldest 30 % low."""
    age = (F.unix_seconds(now) - F.unix_seconds(F.col(at).cast("timestamp"))) / 86400.0
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(F.desc(at), *order))
    # in whole numbers: 70 * 0.7 is below 49 in doubles
    band = F.when(10 * (place - 1) < 3 * n, "high").when(10 * place > 7 * n, "low").otherwise("medium")
    return df.withColumn("weight", F.exp(-age / scale_days)).withColumn("band", band)


def half_life(points: DataFrame, by: list[str], turn: str, value: str) -> DataFrame:
    """Baseline (first turn), the first turn below half of it, and the decay per turn."""
    first, last = F.min_by(value, turn), F.max_by(value, turn)
    base = points.groupBy(*by).agg(first.alias("baseline"), last.alias("final"), F.min(turn).alias("t0"), F.max(turn).alias("t1"))
    low = points.join(base.select(*by, "baseline"), by).where(F.col(value) < F.col("baseline") / 2).groupBy(*by).agg(F.min(turn).alias("half_life"))
    decay = F.coalesce(F.try_divide(F.col("baseline") - F.col("final"), (F.col("t1") - F.col("t0")).cast("double")), F.lit(0.0))
    return base.join(low, by, "left").select(*by, "baseline", "final", "half_life", decay.alias("decay"))


def ab_deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """b - a for every key of either; a missing side is 0."""
    x, y = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    d = x.join(y, key, "full_outer").fillna(0.0, ["a", "b"])
    return d.withColumn("delta", F.col("b") - F.col("a"))


def run_totals(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Totals of benchmark runs from rows (by, failed, groundedness, attempts, cost_usd, judge): numbers
    of all and of good clusters, success_rate, means over good ones, cost over all."""
    ok = ~F.coalesce(F.col("failed"), F.lit(False))
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    return clusters.groupBy(*by).agg(
        F.count("*").alias("n_personas"), F.count_if(ok).alias("n_ok"), F.avg(ok.cast("double")).alias("success_rate"),
        F.coalesce(F.avg(F.when(ok, F.coalesce(F.col("groundedness"), F.lit(0.0)))), F.lit(0.0)).alias("groundedness"),
        F.coalesce(F.avg(F.when(ok, F.coalesce(F.col("attempts"), F.lit(0)))), F.lit(0.0)).alias("attempts"),
        F.sum(F.coalesce(F.col("cost_usd"), F.lit(0.0))).alias("cost"), mean("judge").alias("judge"),
    )


def run_deltas(base: DataFrame, branch: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, keep, d_judge, d_groundedness, d_success, cost_pct, n_ok) of branch totals against base totals;
    d_judge is null unless both have judgements, and no base cost gives 0 %."""
    names = ("judge", "groundedness", "success_rate", "cost")
    b = base.select(*by, *(F.col(c).alias(f"b_{c}") for c in names))
    delta = lambda c: F.col(c) - F.col(f"b_{c}")
    return branch.join(b, by).select(
        *by, *keep, delta("judge").alias("d_judge"), delta("groundedness").alias("d_groundedness"), delta("success_rate").alias("d_success"),
        F.coalesce(F.try_divide(delta("cost") * 100, F.col("b_cost")), F.lit(0.0)).alias("cost_pct"), "n_ok",
    )


# The limits of the two verdicts.
def verdict(dj: Column, dg: Column, cost_pct: Column, ds: Column) -> Column:
    """The comparison's verdict on changes of judgement (0 without any), groundedness, cost in per
    cent, and success."""
    j = F.coalesce(dj, F.lit(0.0))
    return (
        F.when((j < -0.1) | (dg < -0.05) | (cost_pct > 50) | (ds < -0.05), "REJECT")
        .when((j >= 0.1) | ((dg >= 0.05) & (ds >= 0)), F.when(cost_pct < 20, "MERGE").otherwise("MERGE-WITH-CAVEAT"))
        .when((F.abs(j) <= 0.02) & (F.abs(dg) <= 0.02) & (F.abs(cost_pct) <= 5) & (F.abs(ds) <= 0.02), "NEUTRAL")
        .otherwise("REVIEW")
    )


def decision(dj: Column, dg: Column, cost_pct: Column, ds: Column, n_ok: Column) -> Column:
    """The final verdict on a branch; without judgements (null) only the others count."""
    j = F.coalesce(dj, F.lit(0.0))
    return (
        F.when(n_ok == 0, "REJECT-BROKEN")
        .when((j < -0.15) | (dg < -0.05) | (ds < -0.10) | (cost_pct > 80), "REJECT")
        .when(ds < -0.05, "REJECT-RELIABILITY")
        .when((j >= 0.15) & (cost_pct < 30), "MERGE")
        .when((dg >= 0.05) & (ds >= 0) & (cost_pct < 30), "MERGE")
        .when((j >= 0.05) & (ds >= 0) & (cost_pct < 15), "MERGE")
        .when((F.abs(j) <= 0.05) & (F.abs(dg) <= 0.02) & (F.abs(cost_pct) <= 10) & (F.abs(ds) <= 0.05), "NEUTRAL")
        .otherwise("REVIEW")
    )


def groundedness(claims: DataFrame, evidence: DataFrame, valid: DataFrame) -> DataFrame:
    """Per persona: the share of claims (persona, path) with evidence whose record ids are all valid
    (persona, record_id); 1 without claims. evidence: (persona, path, record_ids)."""
    e = evidence.withColumn("__i", F.monotonically_increasing_id())
    ids = e.select("persona", "path", "__i", F.explode("record_ids").alias("record_id"))
    bad = ids.join(valid, ["persona", "record_id"], "left_anti").select("__i").distinct()
    good = e.where(F.size("record_ids") > 0).join(bad, "__i", "left_anti").select("persona", "path").distinct().withColumn("ok", F.lit(1))
    d = claims.join(good, ["persona", "path"], "left").groupBy("persona").agg(F.count("*").alias("claims"), F.count("ok").alias("grounded"))
    return d.withColumn("score", F.col("grounded") / F.col("claims")).withColumn("passed", F.col("score") >= 0.9)


def evidence_backfill(claims: DataFrame, evidence: DataFrame, first_record: DataFrame) -> DataFrame:
    """Evidence plus an entry at confidence 0.55 from the persona's first record for each claim
    (persona, path, claim) without any; first_record: (persona, record_id)."""
    missing = claims.join(evidence.select("persona", "path").distinct(), ["persona", "path"], "left_anti").join(first_record, "persona")
    new = missing.select("persona", "path", F.array("record_id").alias("record_ids"), F.lit(0.55).alias("confidence"))
    return evidence.select("persona", "path", "record_ids", "confidence").unionByName(new)
