"""Scorers: each gives rows of one result schema, so that suites are unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, vectors

RESULT = ("dimension_id", "dimension_name", "tier", "persona_id", "passed", "score", "errors")

# Marker expressions of the regex scorers, each a list of whole-word alternatives.
POSITIVE = "love|passionate|thriving|excited|proud|happy|optimistic|successful|excellent|amazing|great|wonderful|fantastic|driven|motivated|enjoy|fulfilling|rewarding|blessed"
NEGATIVE = (
    "struggling|frustrated|stressed|anxious|worried|difficult|overwhelmed|burned.?out|failed|debt|divorced|laid.?off|fired|"
    "depressed|lonely|grieving|addiction|poverty|hardship|conflict|discrimination|disability|illness|unemployed"
)
CHALLENGE = (
    "challenge|difficult|struggle|hard|pain|problem|issue|concern|obstacle|barrier|setback|failure|loss|stress|anxiety|frustrat|"
    "conflict|debt|health\\s+issue|layoff|downsiz"
)
ADVERSITY = (
    "depression|depressed|anxiety|anxious|stressed|stress|unemploy|laid.?off|fired|bankrupt|debt|poverty|homeless|divorced|separated|"
    "widowed|grief|grieving|loss|bereavement|addiction|substance|abuse|trauma|ptsd|disability|illness|chronic\\s+pain|loneliness|lonely|"
    "isolated|discrimination|harassment|bullied|foreclosure|eviction"
)
UNCERTAIN = (
    "not sure|don'?t know|not my area|outside my expertise|can'?t speak to|not really|wouldn'?t know|not qualified|not familiar|"
    "don'?t have experience|I'?d have to|you'?d be better off asking|I'?m not the right person"
)
LEAKAGE = (
    "I am an AI|I'?m an AI|AI language model|large language model|AI assistant|artificial intelligence|trained by|language model|"
    "I cannot comply|I'?m programmed|as a model|my training data|trained by (OpenAI|Anthropic)|I am (GPT|ChatGPT|Claude)|made by (OpenAI|Anthropic)"
)
HEDGES = (
    "it's important to note", "it's worth noting", "it's worth mentioning", "it's important to consider", "certainly", "absolutely", "of course",
    "needless to say", "it goes without saying", "with that said", "that being said", "having said that", "at the end of the day",
    "all things considered", "it's crucial to", "it's essential to", "it's vital to", "I would like to", "I'd be happy to", "I hope this helps",
    "feel free to", "allow me to", "I'd like to point out", "I feel it's important", "I think it's fair to say", "to be fair", "to be honest",
    "to be clear", "I must say", "I have to say",
)
EMOTIONS = {
    "anger": "angry|furious|outraged|hate|rage|livid|infuriated|annoyed|irritated|mad",
    "sadness": "sad|depressed|miserable|heartbroken|grief|sorrowful|unhappy|devastated|crying|tears",
    "joy": "happy|excited|thrilled|delighted|joyful|elated|ecstatic|wonderful|fantastic|amazing",
    "fear": "scared|terrified|frightened|anxious|worried|panicked|nervous|dread|afraid",
    "neutral": "think|consider|understand|appreciate|suggest|approach|interesting|perspective",
}
FILLER = r"(?i)^\s*(n/?a|not specified|unknown|tbd|to be determined|none|placeholder|lorem|example)\s*$"
REQUIRED_TEXT = ("name", "occupation", "industry", "location", "education", "lifestyle", "bio")
REQUIRED_LISTS = ("goals", "pain_points", "values", "knowledge_domains", "personality_traits", "behaviors")
BIO_LENGTH = 50
LIST_FIELDS = ("goals", "pain_points", "values", "knowledge_domains", "behaviors")
EMPATHY = (
    "sorry|understand|feel|must be|that sounds|difficult|tough|hard|support|care|hear|empathize|sympathize|compassion|concern|"
    "how are you|are you ok|holding up|here for you|listen|I can only imagine|that.s awful|my heart goes out|challenging|overwhelming|painful"
)
DISMISSIVE = (
    "get over it|stop complaining|toughen up|not a big deal|everyone|statistically|you should have|obviously|just deal|move on|"
    "that.s life|grow up|suck it up|why would you"
)
INDIVIDUALISM = (
    "individual\\s+freedom|personal\\s+achievement|self.reliance|autonomy|self.made|personal\\s+success|independence|individual\\s+rights|"
    "personal\\s+responsibility|self.sufficiency|meritocracy|personal\\s+goals?|individual\\s+autonomy|self.determination"
)
COLLECTIVISM = (
    "community|family\\s+harmony|collective|solidarity|group\\s+harmony|communal|filial\\s+piety|ubuntu|kinship|mutual\\s+aid|"
    "shared\\s+responsibility|group\\s+loyalty|clan|tribe|communal\\s+duty|social\\s+cohesion|respect\\s+for\\s+elders|intergenerational|bonds"
)
WEIRD_REGIONS = (
    "usa|united states|u\\.s\\.|uk|united kingdom|canada|australia|new zealand|western europe|germany|france|netherlands|sweden|"
    "norway|denmark|finland|switzerland|austria|belgium"
)
#: Both-sides framing; a gap doesn't cross lines.
BALANCED = (
    "on the other hand\\b|however.{0,60}also\\b|while.{0,60}(also|yet)\\b|both sides\\b|pros and cons\\b|advantages and disadvantages\\b|"
    "it depends\\b|on one hand.{0,100}on the other\\b|that said.{0,60}also\\b|although.{0,60}however\\b"
)
REFUSALS = (
    "I'?m not sure|I don'?t (really )?know|outside my expertise|not (really )?my (area|field)|can'?t speak to|don'?t have experience|"
    "I'?d have to|you'?d (need|want) to ask|I'?m not (qualified|the right person)"
)
#: What a word of a persona's mood lets expect; the first that the mood holds.
MOODS = (
    ("calm", "neutral"), ("neutral", "neutral"), ("reserved", "neutral"), ("stoic", "neutral"), ("analytical", "neutral"), ("realistic", "neutral"),
    ("cheerful", "joy"), ("happy", "joy"), ("optimistic", "joy"), ("excited", "joy"), ("joyful", "joy"),
    ("anxious", "fear"), ("nervous", "fear"), ("worried", "fear"), ("melancholy", "sadness"), ("sad", "sadness"), ("gloomy", "sadness"),
    ("irritable", "anger"), ("angry", "anger"), ("aggressive", "anger"),
)


def whole_words(alternatives: str) -> str:
    return rf"(?i)\b({alternatives})\b"


def result(df: DataFrame, dimension: str, name: str, tier: int, passed: Column, score: Column, errors: Column | None = None, persona: str = "persona_id") -> DataFrame:
    return df.select(
        F.lit(dimension).alias("dimension_id"), F.lit(name).alias("dimension_name"), F.lit(tier).alias("tier"), F.col(persona).cast("string").alias("persona_id"),
        passed.alias("passed"), score.cast("double").alias("score"), (errors if errors is not None else F.array().cast("array<string>")).alias("errors"),
    )


def schema_compliance(personas: DataFrame) -> DataFrame:
    """Tier 1: an id and a name, a possible age and experience, and lists where lists belong (a column
    that isn't there has empty ones)."""
    kinds = {f.name: f.dataType.typeName() for f in personas.schema.fields}
    no_list = lambda c: F.col(c).isNull() if kinds[c] == "array" else F.lit(True)
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    errors = F.array_compact(
        F.array(
            F.when(blank("persona_id"), "id"),
            F.when(blank("name"), "name"),
            F.when((F.col("age") <= 0) | (F.col("age") >= 130), "age"),
            F.when(F.col("experience_years") < 0, "experience_years"),
            *(F.when(no_list(c), c) for c in LIST_FIELDS if c in kinds),
        )
    )
    return result(personas, "D1", "Schema Compliance", 1, F.size(errors) == 0, F.greatest(F.lit(0.0), 1 - F.lit(0.2) * F.size(errors)), errors)


def completeness(personas: DataFrame) -> DataFrame:
    """Tier 1: required fields are there, no fillers, a biography of some length."""
    checks = []
    for c in REQUIRED_TEXT:
        v = F.coalesce(F.col(c), F.lit(""))
        bad = (F.trim(v) == "") | v.rlike(FILLER)
        checks.append(F.when(bad | (F.length(v) < BIO_LENGTH) if c == "bio" else bad, c))
    for c in REQUIRED_LISTS:
        checks.append(F.when(F.col(c).isNull() | (F.size(c) <= 0) | F.exists(c, lambda x: x.rlike(FILLER)), c))
    errors = F.array_compact(F.array(*checks))
    return result(personas, "D2", "Completeness", 1, F.size(errors) == 0, 1 - F.size(errors) / len(checks), errors)


def consistency(personas: DataFrame) -> DataFrame:
    """Tier 1: title and experience, age and experience, budget and luxury, introvert and stage."""
    job, years, age = F.lower(F.coalesce("occupation", F.lit(""))), F.col("experience_years"), F.col("age")
    joined = lambda *cs: F.lower(F.concat_ws(" ", *cs))
    senior = job.rlike(r"\b(senior|lead|principal|director|vp|chief|head)\b")
    entry = job.rlike(r"\b(junior|intern|entry|trainee)\b")
    rules = {
        "senior title, little experience": senior & (years < 3),
        "entry title, long experience": entry & (years > 10),
        "at work before 14": (age - years) < 14,
        "budget and luxury": joined("values", "behaviors").contains("budget") & joined("lifestyle", "bio").contains("luxury"),
        "introvert on stage": joined("personality_traits").contains("introvert") & joined("behaviors", "goals").contains("public speaking") & ~joined("personality_traits").contains("extrovert"),
    }
    errors = F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))
    return result(personas, "D3", "Consistency", 1, F.size(errors) == 0, F.greatest(F.lit(0.0), 1 - F.lit(0.25) * F.size(errors)), errors)


def demographic_coherence(personas: DataFrame) -> DataFrame:
    """Tier 2: five combinations that hardly occur."""
    age, low = F.col("age"), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rules = {
        "doctorate before 24": low("education").contains("phd") & (age < 24),
        "top role before 25": low("occupation").rlike("ceo|chief|vp|vice president|director") & (age < 25),
        "widowed before 25": low("marital_status").contains("widow") & (age < 25),
        "high income, school only, before 30": low("education").contains("high school") & (F.col("income_bracket") == "high") & (age < 30),
        "more experience than years since 16": F.col("experience_years") > age - 16,
    }
    errors = F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items())))
    return result(personas, "D7", "Demographic Coherence", 2, F.size(errors) == 0, (5 - F.size(errors)) / 5, errors)


def marker_rate(df: DataFrame, by: list[str], text_col: str, alternatives: str) -> DataFrame:
    """(by, n, hits): rows, and rows with any of the markers."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(text_col).rlike(whole_words(alternatives))).alias("hits"))


def hedge_rate(df: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """(by, hedges, words, per_hundred) over all rows of a group."""
    hits = text.marker_count(F.col(text_col), [h.replace(".", "\\.") for h in HEDGES])
    n = F.size(F.filter(F.split(text_col, "\\s+"), lambda w: w != ""))
    d = df.groupBy(*by).agg(F.sum(hits).alias("hedges"), F.sum(n).alias("words"))
    return d.withColumn("per_hundred", F.coalesce(F.try_divide(F.col("hedges") * 100.0, F.col("words")), F.lit(0.0)))


def positivity(df: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """D19 over rows (by, text) of a persona each: (by, positive, negative, challenged, n, ratio,
    challenge_share, score, passed, skipped). Best is a ratio of 0.6 with a tenth challenged; a set
    without any marker is skipped: passed, score 1."""
    count = lambda p: F.sum(F.regexp_count(text_col, F.lit(whole_words(p))))
    d = df.groupBy(*by).agg(count(POSITIVE).alias("positive"), count(NEGATIVE).alias("negative"), F.count_if(F.col(text_col).rlike(whole_words(CHALLENGE))).alias("challenged"), F.count("*").alias("n"))
    d = d.withColumn("ratio", F.try_divide(F.col("positive").cast("double"), (F.col("positive") + F.col("negative")).cast("double")))
    d = d.withColumn("challenge_share", F.col("challenged") / F.col("n")).withColumn("skipped", F.col("ratio").isNull())
    score = (F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.col("ratio") - 0.6)) + F.least(F.lit(1.0), F.col("challenge_share") / 0.1)) / 2
    passed = (F.col("ratio") < 0.8) & (F.col("challenge_share") >= 0.1)
    return d.withColumn("score", F.when(F.col("skipped"), 1.0).otherwise(score)).withColumn("passed", F.col("skipped") | passed)


def weird_bias(df: DataFrame, by: list[str], text_col: str, location: str) -> DataFrame:
    """D21 over rows (by, text, location) of a persona each: (by, n, individual, collective, ratio,
    location_share, score, passed). Without markers the ratio is 0.5."""
    count = lambda p: F.sum(F.regexp_count(text_col, F.lit(whole_words(p))))
    there = F.coalesce(F.col(location), F.lit("")).rlike(whole_words(WEIRD_REGIONS))
    d = df.groupBy(*by).agg(F.count("*").alias("n"), count(INDIVIDUALISM).alias("individual"), count(COLLECTIVISM).alias("collective"), F.avg(there.cast("double")).alias("location_share"))
    total = (F.col("individual") + F.col("collective")).cast("double")
    d = d.withColumn("ratio", F.coalesce(F.try_divide(F.col("individual").cast("double"), total), F.lit(0.5)))
    by_ratio = F.greatest(F.lit(0.0), 1 - 2 * F.greatest(F.lit(0.0), F.col("ratio") - 0.5))
    d = d.withColumn("score", (by_ratio + 1 - F.col("location_share")) / 2)
    return d.withColumn("passed", (F.col("ratio") < 0.7) & (F.col("location_share") < 0.8))


def language_shift(responses: DataFrame, scored: DataFrame, most: float = 0.30) -> DataFrame:
    """D21's second part: responses (question_id, language, v) of several languages to one question;
    the mean distance of the languages' mean vectors over questions and pairs of languages. A shift
    over ``most`` fails the set and bounds its score; without pairs ``scored`` stays as it is."""
    c = vectors.centroids(responses, ["question_id", "language"], "v")
    a, b = (c.select("question_id", F.col("language").alias(x), F.col("centroid").alias(f"v{x}")) for x in "ab")
    pairs = a.join(b, "question_id").where("a < b")  # of the languages of one question
    shift = pairs.agg(F.avg(1 - vectors.cosine(F.col("va"), F.col("vb"))).alias("shift"), F.count("*").alias("comparisons"))
    d = scored.join(shift, F.lit(True))  # one row
    far = F.coalesce(F.col("shift") > most, F.lit(False))
    return d.withColumn("passed", F.col("passed") & ~far).withColumn("score", F.when(far, F.least("score", 1 - F.col("shift"))).otherwise(F.col("score")))


def dominant_emotion(text_col: Column) -> Column:
    """The emotion with most hits, the first named of equal ones; neutral without any."""
    hits = F.array(*(F.struct(F.regexp_count(text_col, F.lit(whole_words(p))).alias("n"), F.lit(-i).alias("at"), F.lit(k).alias("name")) for i, (k, p) in enumerate(EMOTIONS.items())))
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["name"]).otherwise("neutral")


def opinion_diversity(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per field: mode share, variation, evenness and their mean, from counts of values."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return stats.entropy(counts, by).withColumn("score", (F.col("variation") + F.col("evenness")) / 2)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, chi2, v) of two columns from their contingency table."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    # chi2 / n + 1 = sum over cells of o^2 / (row sum * column sum)
    d = t.withColumn("ra", F.sum("o").over(Window.partitionBy(a))).withColumn("rb", F.sum("o").over(Window.partitionBy(b)))
    d = d.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("s"), F.sum("o").alias("n"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    phi2 = F.greatest(F.col("s") - 1, F.lit(0.0))
    v = F.sqrt(F.coalesce(F.try_divide(phi2, (F.least("ka", "kb") - 1).cast("double")), F.lit(0.0)))
    return d.select("n", (phi2 * F.col("n")).alias("chi2"), F.least(v, F.lit(1.0)).alias("v"))


def mean_pairwise_cosine(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, n, mean_cosine, radius) without forming pairs: n unit vectors with sum s have mean
    pairwise cosine (|s|^2 - n) / (n (n - 1)), and mean cosine |s| / n to their centroid."""
    unit = df.withColumn("u", vectors.unit(F.col(vector)))
    s = unit.select(*by, F.posexplode("u").alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    d = s.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    n = F.col("n").cast("double")
    return d.select(*by, "n", F.when(n < 2, 1.0).otherwise(F.try_divide(F.col("q") - n, n * (n - 1))).alias("mean_cosine"), (F.sqrt("q") / n).alias("radius"))


def sliding_coherence(df: DataFrame, order: str, vector: str, by: list[str], size: int = 10, step: int = 5) -> DataFrame:
    """Mean cosine of the vectors of each window to its centroid; windows of ``size`` rows, every ``step``."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    d = df.withColumn("at", at).withColumn("n", n).withColumn("u", vectors.unit(F.col(vector)))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size) / step) + 1).cast("int")
    last = F.least(F.floor(F.col("at") / step), F.floor((F.col("n") - size) / step)).cast("int")
    d = d.withColumn("window", F.explode(F.when((F.col("n") >= size) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    raw = vectors.centroids(d, [*by, "window"], vector)
    own = F.aggregate(F.zip_with("u", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / (vectors.norm(F.col("centroid")) + F.lit(vectors.TINY))
    return d.join(raw, [*by, "window"]).groupBy(*by, "window").agg(F.avg(own).alias("coherence"), F.count("*").alias("n"))


def psi(base: DataFrame, current: DataFrame, key: str, floor: float = 1e-6) -> DataFrame:
    """Population stability index of two tables of counts (key, n)."""
    share = lambda d, name: stats.shares(d, [], "n", name).select(key, name)
    d = share(base, "b").join(share(current, "c"), key, "full_outer")
    b, c = (F.greatest(F.coalesce(F.col(x), F.lit(0.0)), F.lit(floor)) for x in "bc")
    return d.agg(F.sum((c - b) * F.log(c / b)).alias("psi"))


def suite(scorers: list, personas: DataFrame, max_tier: int | None = None, only_tier: int | None = None) -> DataFrame:
    """Results of per-persona scorers, with a column skipped: tiers up to ``max_tier`` with gating, or
    one tier without.

    With gating, a persona that fails tier 1 has its later tiers reported as failed and skipped."""
    rows = reduce(lambda a, b: a.unionByName(b), (s(personas) for s in scorers)).withColumn("skipped", F.lit(False))
    if only_tier is not None:
        return rows.where(F.col("tier") == only_tier)
    if max_tier is not None:
        rows = rows.where(F.col("tier") <= max_tier)
    failed = rows.where("tier = 1 and not passed").select(F.col("persona_id").alias("failed")).distinct()
    return _gated(rows.join(failed, F.col("persona_id") == F.col("failed"), "left"), (F.col("tier") > 1) & F.col("failed").isNotNull())


def _gated(rows: DataFrame, skipped: Column) -> DataFrame:
    return rows.select(
        "dimension_id", "dimension_name", "tier", "persona_id",
        F.when(skipped, F.lit(False)).otherwise(F.col("passed")).alias("passed"),
        F.when(skipped, 0.0).otherwise(F.col("score")).alias("score"),
        F.when(skipped, F.array(F.lit("skipped: tier 1 failed"))).otherwise(F.col("errors")).alias("errors"),
        (F.col("skipped") | skipped).alias("skipped"),
    )


SET = "__set__"


def set_result(scored: DataFrame, dimension: str, name: str, tier: int) -> DataFrame:
    """One row of a set-level scorer's (passed, score) as a result of the whole set."""
    return result(scored.withColumn("persona_id", F.lit(SET)), dimension, name, tier, F.col("passed"), F.col("score")).withColumn("skipped", F.lit(False))


def suite_full(scorers: list, set_results: list[DataFrame], personas: DataFrame, only_tier: int | None = None) -> DataFrame:
    """All results: per persona with gating, then those of the set (of :func:`set_result`), which are
    failed and skipped if any persona fails tier 1. One tier alone isn't gated by others."""
    own = suite(scorers, personas, only_tier=only_tier)
    if not set_results:
        return own
    of_set = reduce(lambda a, b: a.unionByName(b), set_results)
    if only_tier is not None:
        of_set = of_set.where(F.col("tier") == only_tier)
    failed = own.agg(F.coalesce(F.bool_or((F.col("tier") == 1) & ~F.col("passed")), F.lit(False)).alias("failed"))  # one row
    return own.unionByName(_gated(of_set.join(failed, F.lit(True)), F.col("failed")))
