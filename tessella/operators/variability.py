"""How judges' scores vary: discrimination, coefficients of variation, test and retest; what evidence
entails; how vocabularies overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def cv(x: Column) -> Column:
    """Population deviation over the mean; 0 where the mean is 0."""
    mean = F.avg(x)
    return F.when(mean == 0, 0.0).otherwise(F.try_divide(F.stddev_pop(x), mean))


def variation(scores: DataFrame) -> DataFrame:
    """(level, name, n, cv) of scores (persona_id, dimension, score): of all pooled, of each persona over its
    dimensions, and of each dimension over personas; one pass."""
    d = scores.where("score is not null").select(F.col("persona_id").cast("string").alias("persona_id"), "dimension", "score")
    d = d.groupingSets([["persona_id"], ["dimension"], []], "persona_id", "dimension").agg(F.count("*").alias("n"), cv(F.col("score")).alias("cv"), F.grouping("persona_id").alias("p"), F.grouping("dimension").alias("d"))
    level = F.when(F.col("p") == 0, "persona").when(F.col("d") == 0, "dimension").otherwise("all")
    return d.where("n > 0").select(level.alias("level"), F.coalesce("persona_id", "dimension", F.lit("")).alias("name"), "n", "cv")


def discrimination(scores: DataFrame) -> DataFrame:
    """(a, b, dimensions, different, rate) of all pairs of personas that were judged on one dimension: on how
    many of the dimensions that both have their verdicts (persona_id, dimension, verdict) differ. The
    output is a row for each pair, so it is for sets of personas, not for a corpus."""
    x = lambda name: scores.where("verdict is not null").select("dimension", F.col("persona_id").alias(name), F.col("verdict").alias(f"v{name}"))
    d = x("a").join(x("b"), "dimension").where("a < b")
    d = d.groupBy("a", "b").agg(F.count("*").alias("dimensions"), F.count_if(F.col("va") != F.col("vb")).alias("different"))
    return d.withColumn("rate", F.col("different") / F.col("dimensions"))


def retest(runs: DataFrame) -> DataFrame:
    """(setting, dimension, n, mean, deviation, spread) of repeated scores (setting, dimension, score), and with
    dimension null those of all dimensions of a setting together."""
    d = runs.where("score is not null").rollup("setting", "dimension").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), (F.max("score") - F.min("score")).alias("spread"), F.grouping("setting").alias("g"))
    return d.where("g = 0").drop("g")


def more_reliable(runs: DataFrame) -> DataFrame:
    """One row: the setting whose scores vary least over all dimensions (ties by name), and its deviation."""
    whole = retest(runs).where("dimension is null")
    return whole.agg(F.min_by("setting", F.struct("deviation", "setting")).alias("setting"), F.min("deviation").alias("deviation"))


def entailment(evaluations: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Per persona of judged claims (persona_id, label, grounded, confidence): claims, rates of entailed, neutral and
    contradicted ones, the share of claims with valid evidence, how many of those aren't entailed (0
    without any), and the judge's mean confidence, added by ``order``, if given."""
    is_ = lambda x: F.col("label") == x
    d = stats.in_order(evaluations, ["persona_id"], [*order]).groupBy("persona_id").agg(
        F.count("*").alias("claims"), *(F.count_if(is_(x)).alias(x) for x in ("entailed", "neutral", "contradicted")), F.count_if("grounded").alias("valid"),
        F.count_if(F.col("grounded") & F.coalesce(~is_("entailed"), F.lit(True))).alias("wrong"), F.avg("confidence").alias("confidence"),
    )
    rates = [(F.col(x) / F.col("claims")).alias(f"{x}_rate") for x in ("entailed", "neutral", "contradicted")]
    return d.select("persona_id", "claims", *rates, (F.col("valid") / F.col("claims")).alias("coverage"), F.coalesce(F.try_divide("wrong", "valid"), F.lit(0.0)).alias("false_positive_rate"), "confidence")


def vocabulary_overlap(words: DataFrame) -> DataFrame:
    """One row over words (persona_id, word), trimmed and in lower case, blanks left out: personas, mean_jaccard over
    all their pairs, unique_ratio (words of one persona alone), total and shared words.

    Only pairs that share a word are formed; all others add 0. Under two personas the mean is 0 and
    every word counts as unique."""
    w = words.select("persona_id", F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    size = w.groupBy("persona_id").agg(F.count("*").alias("n"))
    held = w.groupBy("word").agg(F.count("*").alias("k"))
    a, b = (w.select("word", F.col("persona_id").alias(x)) for x in "ab")
    shared = a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("s"))
    for x in "ab":
        shared = shared.join(size.select(F.col("persona_id").alias(x), F.col("n").alias(f"n{x}")), x)
    total = shared.agg(F.coalesce(F.sum(F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))), F.lit(0.0)).alias("sum"))
    counts = held.agg(F.count("*").alias("total"), F.count_if(F.col("k") == 1).alias("unique"))
    personas = size.agg(F.count("*").alias("personas"))
    d = total.join(counts, F.lit(True)).join(personas, F.lit(True))  # one row each
    pairs = F.col("personas") * (F.col("personas") - 1) / 2
    few = F.col("personas") < 2
    return d.select(
        "personas", F.when(few, 0.0).otherwise(F.try_divide(F.col("sum"), pairs)).alias("mean_jaccard"),
        F.when(few, 1.0).otherwise(F.try_divide("unique", "total")).alias("unique_ratio"), "total", (F.col("total") - F.col("unique")).alias("shared"),
    )
