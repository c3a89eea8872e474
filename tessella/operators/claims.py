"""Claims of personas and the evidence behind them. A claim is (persona, path, text), its path a field
and a number such as goals.0; evidence is (persona, path, record_ids, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Words that make a claim a sensitive one, found anywhere in its lower-cased text.
SENSITIVE = {
    "financial": ("budget", "cost", "price", "revenue", "spend", "roi", "invest", "money", "pay", "salary"),
    "medical": ("health", "medical", "diagnosis", "treatment", "patient", "clinical", "symptom"),
    "security": ("password", "auth", "credential", "vulnerability", "breach", "exploit", "attack"),
    "legal": ("compliance", "regulation", "gdpr", "hipaa", "legal", "liability", "audit"),
}
LEAST_SOURCES = 2
# How many items each list field of a persona has, at least and at most.
LIST_LENGTHS = {
    "goals": (2, 8), "pains": (2, 8), "motivations": (2, 6), "objections": (1, 6), "channels": (1, 8), "vocabulary": (3, 15),
    "decision_triggers": (1, 6), "sample_quotes": (2, 5), "journey_stages": (2, 5), "source_evidence": (3, None),
}
# Words of a claim that say nothing about its source.
STOPWORDS = (
    "the a an and or of in for to with that their our is are was were be been have has this it its at by from on as not but so "
    "they we you he she also which what when how can will would could should may might do did use used using get got need needs work works"
).split()
WEAK_OVERLAP = 0.1


def length_errors(personas: DataFrame, limits: dict[str, tuple[int, int | None]] = LIST_LENGTHS) -> Column:
    """Names of list columns that are missing, too short or too long."""
    checks = []
    for c, (least, most) in limits.items():
        if c in personas.columns:
            n = F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(-1))
            checks.append(F.when((n < least) | (n > most if most is not None else F.lit(False)), c))
    return F.array_compact(F.array(*checks))


def categories(x: Column) -> Column:
    """The sensitive categories of a text, in their order."""
    return F.transform(F.array(F.lower(x)), lambda low: F.array_compact(F.array(*(F.when(text.any_of(low, words), k) for k, words in SENSITIVE.items()))))[0]


def domain_rules(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(persona, path, text, categories, sources, satisfied) of the sensitive claims: how many records
    back each, and whether those are enough."""
    ids = evidence.select("persona", "path", F.explode("record_ids").alias("id")).groupBy("persona", "path").agg(F.count_distinct("id").alias("sources"))
    d = claims.withColumn("categories", categories(F.col("text"))).where(F.size("categories") > 0).join(ids, ["persona", "path"], "left").fillna(0, ["sources"])
    return d.select("persona", "path", "text", "categories", "sources", (F.col("sources") >= LEAST_SOURCES).alias("satisfied"))


def domain_summary(claims: DataFrame, flagged: DataFrame) -> DataFrame:
    """(persona, claims, sensitive, rate) and one column a category with its number of claims."""
    n = claims.groupBy("persona").agg(F.count("text").alias("claims"))
    of = [F.count_if(F.array_contains("categories", k)).alias(k) for k in SENSITIVE]
    d = n.join(flagged.groupBy("persona").agg(F.count("*").alias("sensitive"), *of), "persona", "left").fillna(0, ["sensitive", *SENSITIVE])
    return d.withColumn("rate", F.coalesce(F.try_divide(F.col("sensitive").cast("double"), F.col("claims").cast("double")), F.lit(0.0)))


def provenance(values: DataFrame, valid: DataFrame) -> DataFrame:
    """Per persona: the share of values (persona, path, record_ids) all of whose records are valid
    (persona, record_id); a value without any counts as covered."""
    ids = values.select("persona", "path", F.explode("record_ids").alias("record_id"))
    bad = ids.join(valid, ["persona", "record_id"], "left_anti").select("persona", "path").distinct().withColumn("bad", F.lit(1))
    d = values.join(bad, ["persona", "path"], "left").groupBy("persona").agg(F.count("*").alias("total"), (F.count("*") - F.count("bad")).alias("covered"))
    return d.withColumn("score", F.col("covered") / F.col("total"))


def apply_verdicts(evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Evidence with the judge's verdicts (persona, path, verdict) applied: dropped entries go, revised
    ones lose 0.2 of confidence down to 0.3, others are kept; a column says which."""
    d = evidence.join(verdicts.select("persona", "path", "verdict"), ["persona", "path"], "left").where("verdict is null or verdict <> 'drop'")
    revised = F.coalesce(F.col("verdict") == "revise", F.lit(False))
    lower = F.greatest(F.lit(0.3), F.coalesce(F.col("confidence"), F.lit(0.5)) - 0.2)
    return d.withColumn("confidence", F.when(revised, lower).otherwise(F.col("confidence"))).withColumn("revised", revised).drop("verdict")


def _words(x: Column, drop: list[str]) -> Column:
    return F.array_distinct(F.filter(x, lambda w: ~w.isin(*drop)))


def claim_tokens(x: Column) -> Column:
    """Words of over three characters, as written, without case and punctuation around them."""
    long_ = F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 3)
    return _words(F.transform(long_, lambda w: F.lower(F.regexp_replace(w, r"^[.,;:'\"()]+|[.,;:'\"()]+$", ""))), STOPWORDS)


def payload_tokens(x: Column) -> Column:
    """Words of ASCII letters and digits of over three characters."""
    return _words(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > 3), STOPWORDS)


def semantic_overlap(claims: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """(persona, path, overlap, structural, semantic, diverges) of claims with evidence: the share of a
    claim's words that its records (persona, record_id, text) have; structural says that all its
    records are there; the two diverge where words are missing though the records are there."""
    e = evidence.where(F.size("record_ids") > 0).select("persona", "path", F.explode(F.array_distinct("record_ids")).alias("record_id"))
    known = records.groupBy("persona", "record_id").agg(F.array_distinct(F.flatten(F.collect_set(payload_tokens(F.col("text"))))).alias("words"))  # of one record
    met = e.join(known, ["persona", "record_id"], "left")
    ok = met.groupBy("persona", "path").agg(F.min(F.col("words").isNotNull()).alias("structural"))
    c = claims.join(ok, ["persona", "path"]).withColumn("mine", claim_tokens(F.col("text")))
    hits = c.select("persona", "path", F.explode("mine").alias("w")).join(met.select("persona", "path", F.explode("words").alias("w")).distinct(), ["persona", "path", "w"]).groupBy("persona", "path").agg(F.count("*").alias("hits"))
    d = c.join(hits, ["persona", "path"], "left").withColumn("overlap", F.coalesce("hits", F.lit(0)) / F.greatest(F.size("mine"), F.lit(1)))
    d = d.withColumn("semantic", F.col("overlap") >= WEAK_OVERLAP)
    return d.select("persona", "path", "overlap", "structural", "semantic", (F.col("structural") & ~F.col("semantic")).alias("diverges"))


def semantic_groundedness(claims: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per persona: mean overlap of claims with evidence, how many, how many weak, and their share of all."""
    n = claims.groupBy("persona").agg(F.count("*").alias("claims"))
    d = overlaps.groupBy("persona").agg(F.avg("overlap").alias("score"), F.count("*").alias("backed"), F.count_if(~F.col("semantic")).alias("weak"))
    d = n.join(d, "persona", "left").fillna(0, ["backed", "weak"]).fillna(0.0, ["score"])
    return d.withColumn("coverage", F.col("backed") / F.col("claims"))
