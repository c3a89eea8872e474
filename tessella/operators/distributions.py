"""Set-level scorers of how values are distributed over personas. Values come long, (persona, field,
value) without blanks; each scorer gives one row with score, passed, skipped and its figures.
A set too small for a scorer is skipped: passed, score 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats

COLLAPSED, STEREOTYPE, DOMINANT = 0.8, 0.7, 0.85
SPLITS = 5


def _result(d: DataFrame, enough: Column, score: Column, passed: Column, *figures: str) -> DataFrame:
    """``d`` has one row; a null score is one of nothing to compare."""
    ok = enough & score.isNotNull()
    return d.select(F.when(ok, score).otherwise(1.0).alias("score"), F.coalesce(F.when(ok, passed), F.lit(True)).alias("passed"), (~ok).alias("skipped"), *figures)


def _size(values: DataFrame) -> DataFrame:
    return values.agg(F.count_distinct("persona").alias("personas"))


def diversity(values: DataFrame, surveys: DataFrame | None = None, least: int = 20) -> DataFrame:
    """The mean of fields' evenness and variation; fields with a value of over 80 % are collapsed,
    and surveys (question_id, response) in which 40 % of the questions with three answers have one of
    80 % or more are entrenched; both fail the set."""
    counts = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    f = stats.entropy(counts, ["field"]).join(counts.groupBy("field").agg(F.sum("n").alias("total")), "field").where("total >= 2")
    d = f.agg(((F.avg("evenness") + F.avg("variation")) / 2).alias("raw"), F.count_if(F.col("mode_share") > COLLAPSED).alias("collapsed")).join(_size(values), F.lit(True))
    entrenched = F.lit(False)
    if surveys is not None:
        q = surveys.where("question_id is not null and response is not null").groupBy("question_id", "response").agg(F.count("*").alias("n"))
        q = q.groupBy("question_id").agg((F.max("n") / F.sum("n")).alias("mode"), F.sum("n").alias("total")).where("total >= 3")
        d = d.join(q.agg(F.coalesce(F.avg((F.col("mode") >= 0.8).cast("double")), F.lit(0.0)).alias("entrenchment")), F.lit(True))
        entrenched = F.col("entrenchment") >= 0.4
    passed = (F.col("collapsed") == 0) & (F.col("raw") >= 0.3) & ~entrenched
    return _result(d, F.col("personas") >= least, F.col("raw"), passed, "collapsed", *(["entrenchment"] if surveys is not None else []))


def variance(numbers: DataFrame, least: int = 20) -> DataFrame:
    """D14 over (persona, field, number): the mean over fields of the coefficient of variation, full at
    0.3; a field without any variation fails the set."""
    f = numbers.where("number is not null").groupBy("field").agg(F.avg("number").alias("mean"), F.stddev_pop("number").alias("std"), F.count("*").alias("n")).where("n >= 5")
    cv = F.when(F.col("mean") != 0, F.col("std") / F.when(F.col("mean") != 0, F.col("mean"))).otherwise(0.0)
    d = f.agg(F.avg(F.when(F.col("std") == 0, 0.0).otherwise(F.least(F.lit(1.0), cv / 0.3))).alias("raw"), F.count_if(F.col("std") == 0).alias("constant")).join(_size(numbers), F.lit(True))
    return _result(d, F.col("personas") >= least, F.col("raw"), (F.col("constant") == 0) & (F.col("raw") >= 0.3), "constant")


def aggregation(values: DataFrame, groups: DataFrame, least: int = 50) -> DataFrame:
    """One less the mean divergence of halves of the set (``SPLITS`` deals by a hash of the persona)
    over fields, and of groups (persona, grouping, name) of three personas or more against all, for
    groupings with two such groups; the mean over splits and over groupings and fields."""
    seeds = F.explode(F.array(*(F.lit(i) for i in range(SPLITS)))).alias("seed")
    d = values.select("persona", "field", "value", seeds).withColumn("first", F.substring(F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("persona").cast("string"))), 1, 1) < "8")
    half = lambda k: d.where(k).groupBy("seed", "field", "value").agg(F.count("*").alias("n"))
    splits = stats.jsd(half("first"), half("not first"), "value", ["seed", "field"]).groupBy("seed").agg((1 - F.avg("jsd")).alias("consistency")).drop("seed")
    size = groups.groupBy("grouping", "name").agg(F.count_distinct("persona").alias("n")).where("n >= 3")
    some = size.groupBy("grouping").agg(F.count("*").alias("k")).where("k >= 2").select("grouping")
    members = groups.join(size.join(some, "grouping").select("grouping", "name"), ["grouping", "name"])
    own = values.join(members, "persona").groupBy("grouping", "name", "field", "value").agg(F.count("*").alias("n"))
    overall = values.groupBy("field", "value").agg(F.count("*").alias("n"))
    against = own.select("grouping", "name", "field").distinct().join(overall, "field").select("grouping", "name", "field", "value", "n")
    by_group = stats.jsd(own, against, "value", ["grouping", "name", "field"]).groupBy("grouping", "field").agg((1 - F.avg("jsd")).alias("consistency")).select("consistency")
    out = splits.unionByName(by_group).agg(F.avg("consistency").alias("raw"), F.count("*").alias("comparisons")).join(_size(values), F.lit(True))
    return _result(out, F.col("personas") >= least, F.col("raw"), F.col("raw") >= 0.7, "comparisons")


def minority(values: DataFrame, groups: DataFrame, least: int = 30) -> DataFrame:
    """The mean evenness of each field within groups (persona, name) of three personas or more."""
    size = groups.groupBy("name").agg(F.count_distinct("persona").alias("k")).where("k >= 3")
    c = values.join(groups.join(size, "name").select("persona", "name"), "persona").groupBy("name", "field", "value").agg(F.count("*").alias("n"))
    enough = c.groupBy("name", "field").agg(F.sum("n").alias("total")).where("total >= 2")
    f = stats.entropy(c, ["name", "field"]).join(enough, ["name", "field"])
    d = f.agg(F.avg("evenness").alias("raw"), F.count("*").alias("cells")).join(_size(values), F.lit(True))
    return _result(d, F.col("personas") >= least, F.col("raw"), F.col("raw") >= 0.3, "cells")


def field_association(values: DataFrame) -> DataFrame:
    """(a, b, n, v): Cramer's V of each two fields (of ten values or more) that five personas have both."""
    enough = values.groupBy("field").agg(F.count("*").alias("k")).where("k >= 10").select("field")
    x = values.join(enough, "field")
    a, b = (x.select("persona", F.col("field").alias(s), F.col("value").alias(f"v{s}")) for s in "ab")
    t = a.join(b, "persona").where("a < b").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("o"))  # a persona's few fields
    rows, columns = (t.groupBy("a", "b", v).agg(F.sum("o").alias(f"r{v}")) for v in ("va", "vb"))
    d = t.join(rows, ["a", "b", "va"]).join(columns, ["a", "b", "vb"])
    d = d.groupBy("a", "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("rva") * F.col("rvb"))).alias("s"), F.sum("o").alias("n"), F.count_distinct("va").alias("ka"), F.count_distinct("vb").alias("kb"))
    k = F.least("ka", "kb") - 1
    v = F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / F.when(k > 0, k))
    return d.where("n >= 5").select("a", "b", "n", F.coalesce(v, F.lit(0.0)).alias("v"))


def joint(values: DataFrame, coefficients: DataFrame | None = None, least: int = 50) -> DataFrame:
    """One less the mean association of fields, halved if any pair's is over 0.7; regression
    coefficients (real, synthetic) of which over a tenth change sign fail the set."""
    d = field_association(values).agg(F.avg("v").alias("mean_v"), F.count_if(F.col("v") > STEREOTYPE).alias("stereotypes")).join(_size(values), F.lit(True))
    flipped = F.lit(False)
    if coefficients is not None:
        flip = ((F.col("real") > 0) & (F.col("synthetic") < 0)) | ((F.col("real") < 0) & (F.col("synthetic") > 0))
        gap = F.abs(F.col("real") - F.col("synthetic"))
        d = d.join(coefficients.agg(F.avg(flip.cast("double")).alias("sign_flips"), F.avg((gap > 0.1).cast("double")).alias("wrong"), F.avg(gap).alias("mae")), F.lit(True))
        flipped = F.coalesce(F.col("sign_flips") > 0.1, F.lit(False))
    score = F.greatest(F.lit(0.0), 1 - F.col("mean_v")) * F.when(F.col("stereotypes") > 0, 0.5).otherwise(1.0)
    passed = (F.col("stereotypes") == 0) & (F.col("mean_v") < 0.5) & ~flipped
    return _result(d, F.col("personas") >= least, score, passed, "mean_v", "stereotypes", *(["sign_flips", "wrong", "mae"] if coefficients is not None else []))


def stereotypes(pairs: DataFrame) -> DataFrame:
    """D23 over (demographic, value, trait) of a persona each, blanks left out: the share of traits of
    two personas or more that aren't all but tied (85 %) to one demographic value; passed if none is."""
    c = pairs.groupBy("demographic", "trait", "value").agg(F.count("*").alias("n"))
    t = c.groupBy("demographic", "trait").agg((F.max("n") / F.sum("n")).alias("top"), F.sum("n").alias("total")).where("total >= 2")
    d = t.agg(F.count("*").alias("pairs"), F.count_if(F.col("top") >= DOMINANT).alias("tied"))
    return _result(d, F.col("pairs") > 0, 1 - F.try_divide(F.col("tied").cast("double"), F.col("pairs").cast("double")), F.col("tied") == 0, "pairs", "tied")
