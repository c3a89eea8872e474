"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at a few counts of a text and votes good, bad, or abstains. How reliable each rule
is isn't given: expectation-maximisation estimates, from the votes of all documents, the share of
good documents and each rule's chance of each vote for good and for bad ones. The posterior
probability of good quality then replaces passing every rule. What the estimation reads is the
number of documents with each combination of votes, at most three to the number of rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, id_and_text, materialize

REPEAT_WINDOW = 8
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30
GOOD, BAD, NONE = 1, -1, 0
#: Estimation: rounds, share of documents that the first guess counts for, first guess of a vote's
#: being right, and of the share of good documents.
ROUNDS, PRIOR_WEIGHT, PRIOR_RIGHT, PRIOR_GOOD = 50, 0.02, 0.9, 0.8

#: name -> (good if, bad if), over the counts of a document. A rule that only knows a defect
#: abstains without it; "plain" and "sentences" speak for a text.
RULES = {
    "symbols": ("false", "5 * n_symbols > n_words"),
    "exclaims": ("false", "10 * n_exclaims > 3 * n_words"),
    "repeats": ("false", "4 * n_repeat_words > n_words"),
    "duplicate_lines": ("false", "n_dup_lines >= 3 and 4 * n_dup_lines > n_lines"),
    "distinct_words": ("false", "8 * n_distinct < n_words or n_distinct * n_distinct < n_words"),
    "word_length": ("false", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "plain": ("50 * (n_symbols + n_exclaims + n_repeat_words) <= n_words", "5 * (n_symbols + n_exclaims) > n_words"),
    "sentences": ("60 * n_stops >= n_words and 2 * n_stops <= n_words", "300 * n_stops < n_words and n_words >= 50"),
}


def _count_of(chars: str) -> Column:
    text = F.col("text")
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) for c in chars)


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct,
    n_exclaims, n_stops) of (doc_id, text)."""
    pair = lambda c, k: F.transform(F.slice(c, F.lit(1), F.size(c) - k), lambda x, i: F.xxhash64(x, F.get(F.col(c), i + k)))
    d = docs.withColumn("words", F.filter(F.split("text", WORD_BREAKS), lambda w: w != ""))
    d = d.withColumn("n", F.size("words"))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    # the hash of each window of 8 words, from those of 1, 2 and 4
    long_enough = F.col("n") >= REPEAT_WINDOW
    d = d.withColumn("h1", F.when(long_enough, F.transform("words", lambda w: F.xxhash64(w))))
    d = d.withColumn("h2", pair("h1", 1)).withColumn("h4", pair("h2", 2)).withColumn("h8", pair("h4", 4))
    d = d.withColumn("repeated", F.size(F.array_distinct("h8")) < F.size("h8"))
    # windows sorted by hash: a window that equals a neighbour is repeated; then back in order of place
    placed = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("sorted", F.when(F.col("repeated"), placed))
    at = lambda i: F.get(F.col("sorted"), i)["h"]
    twice = F.filter("sorted", lambda x, i: x["h"].eqNullSafe(at(i - 1)) | x["h"].eqNullSafe(at(i + 1)))
    d = d.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(F.col("places"), i + 1), p + REPEAT_WINDOW) - p)),
        F.lit(0), lambda a, x: a + x,
    )
    return d.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count_of(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("repeated"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count_of("!").cast("long").alias("n_exclaims"),
        _count_of(".?;:").cast("long").alias("n_stops"),
    )


def votes(counted: DataFrame, rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """``counted`` with a column vote_<name> for each rule: 1 good, -1 bad, 0 abstains."""
    cast = {f"vote_{k}": F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(NONE) for k, (good, bad) in rules.items()}
    return counted.withColumns(cast)


def estimate(patterns: dict[tuple[int, ...], int], k: int, rounds: int = ROUNDS) -> tuple[float, list[dict[tuple[int, int], float]]]:
    """The share of good documents, and for each of k rules the probability of (vote, quality).

    The first guess, rules being mostly right and documents mostly good, stays in as a small share
    of the documents, which keeps the two classes from changing places."""
    n = sum(patterns.values())
    first = {
        (GOOD, GOOD): 0.7 * PRIOR_RIGHT, (BAD, GOOD): 0.7 * (1 - PRIOR_RIGHT), (NONE, GOOD): 0.3,
        (GOOD, BAD): 0.7 * (1 - PRIOR_RIGHT), (BAD, BAD): 0.7 * PRIOR_RIGHT, (NONE, BAD): 0.3,
    }
    good, chance = PRIOR_GOOD, [dict(first) for _ in range(k)]
    weight = max(1.0, PRIOR_WEIGHT * n)
    for _ in range(rounds if n else 0):
        total = {GOOD: 0.0, BAD: 0.0}
        seen = [dict.fromkeys(first, 0.0) for _ in range(k)]
        for pattern, count in patterns.items():
            p = posterior(pattern, good, chance)
            for quality, share in ((GOOD, p), (BAD, 1 - p)):
                total[quality] += count * share
                for j, v in enumerate(pattern):
                    seen[j][v, quality] += count * share
        good = (total[GOOD] + weight * PRIOR_GOOD) / (n + weight)
        chance = [{(v, q): (seen[j][v, q] + weight * first[v, q]) / (total[q] + weight) for v, q in first} for j in range(k)]
    return good, chance


def posterior(pattern: tuple[int, ...], good: float, chance: list[dict[tuple[int, int], float]]) -> float:
    x = math.log(good / (1 - good)) + sum(math.log(c[v, GOOD] / c[v, BAD]) for v, c in zip(pattern, chance, strict=True))
    return 1 / (1 + math.exp(-x))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, tuple[str, str]] = RULES) -> DataFrame:
    """Per input row: doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words, base_failed, kept, probability (of good quality), votes.

    Null and empty texts have no words, so the base fails them; rows without a doc_id and repeated
    rows count like others; an empty table gives an empty result; other columns are not looked at.
    """
    held = votes(materialize(counts(id_and_text(docs, id_col, text_col)), "quality-counts"), rules)
    names = [f"vote_{k}" for k in rules]
    found = held.groupBy(*names).count().collect()  # 3 to the number of rules at most
    good, chance = estimate({tuple(r[x] for x in names): r["count"] for r in found}, len(names))
    logit = F.lit(math.log(good / (1 - good)))
    for x, c in zip(names, chance, strict=True):
        weight = {v: math.log(c[v, GOOD] / c[v, BAD]) for v in (GOOD, BAD, NONE)}
        logit += F.when(F.col(x) == GOOD, weight[GOOD]).when(F.col(x) == BAD, weight[BAD]).otherwise(weight[NONE])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    chance_good = 1 / (1 + F.exp(-logit))
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (chance_good >= 0.5)).alias("kept"),
        chance_good.alias("probability"),
        F.concat_ws(",", *(F.col(x).cast("string") for x in names)).alias("votes"),
    )
