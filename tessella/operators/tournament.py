"""Pairwise judging: both orders of a pair, position bias, wins and strengths.

A verdict has judge, dimension, a and b (the personas), first (who won with a shown first: a, b or
tie) and second (who won with b shown first, by place: a is the one shown first, which is b).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rounds of a strength fit at most.
ROUNDS = 500


def debiased(verdicts: DataFrame) -> DataFrame:
    """With winner (a, b or tie): who won in both orders; and flipped: whether each order named another."""
    turned = F.when(F.col("second") == "a", "b").when(F.col("second") == "b", "a").otherwise("tie")
    agree = F.col("first") == turned
    return verdicts.withColumns(
        {"winner": F.when(agree, F.col("first")).otherwise("tie"), "flipped": ~agree & (F.col("first") != "tie") & (turned != "tie")}
    )


def position_bias(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, votes, flips, rate: how often the order decided."""
    d = debiased(verdicts).groupBy(*by).agg(F.count("*").alias("votes"), F.count_if("flipped").alias("flips"))
    return d.withColumn("rate", F.col("flips") / F.col("votes"))


def win_counts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, persona, wins, ties, losses, score (a tie is half a win)."""
    d = debiased(verdicts)
    side = lambda me, other: d.select(*by, F.col(me).alias("persona"), (F.col("winner") == me).alias("w"), (F.col("winner") == other).alias("l"))
    n = side("a", "b").unionByName(side("b", "a")).groupBy(*by, "persona").agg(F.count_if("w").alias("wins"), F.count_if(~F.col("w") & ~F.col("l")).alias("ties"), F.count_if("l").alias("losses"))
    return n.withColumn("score", F.col("wins") + F.col("ties") / 2)


def strengths(verdicts: DataFrame, by: list[str], prior: float = 0.5, tolerance: float = 1e-7) -> DataFrame:
    """``by``, persona, strength: Bradley-Terry by minorise-maximise over counts of pairs, ties half a win.

    Each pair that met is taken to have won ``prior`` games more on either side, so that all strengths
    are finite; their geometric mean is 1. A round joins the table of pairs (as large as the pairs that
    met, whatever the verdicts) with the strengths, a row for each persona, and writes the new ones; the
    rounds end when no strength changes by more than ``tolerance`` of itself. What comes back to the
    driver is that one number."""
    d = debiased(verdicts)
    half = F.when(F.col("winner") == "tie", 0.5)
    games = lambda me, other: d.select(*by, F.col(me).alias("persona"), F.col(other).alias("rival"), half.when(F.col("winner") == me, 1.0).otherwise(0.0).alias("won"))
    pairs = games("a", "b").unionByName(games("b", "a")).groupBy(*by, "persona", "rival").agg((F.count("*") + 2 * prior).alias("met"), (F.sum("won") + prior).alias("won"))
    own = [*by, "persona"]
    pairs = written(pairs)
    p = pairs.groupBy(*own).agg(F.sum("won").alias("won")).withColumns({"strength": F.lit(1.0), "was": F.lit(1.0)})
    for _ in range(ROUNDS):
        rival = p.select(*by, F.col("persona").alias("rival"), F.col("strength").alias("other"))
        faced = pairs.drop("won").join(rival, [*by, "rival"]).join(p.drop("was"), own)
        new = faced.groupBy(*own, "won", "strength").agg(F.sum(F.col("met") / (F.col("strength") + F.col("other"))).alias("share"))
        new = written(new.select(*own, "won", F.col("strength").alias("was"), (F.col("won") / F.col("share")).alias("strength")))
        mean = new.groupBy(*by).agg(F.exp(F.avg(F.log("strength"))).alias("mean"))
        p = new.join(mean, by).withColumn("strength", F.col("strength") / F.col("mean")).drop("mean")
        moved = p.agg(F.max(F.abs(F.log(F.col("strength") / F.col("was"))))).first()[0]
        if moved is None or moved < tolerance:
            return p.select(*own, "strength")
    raise RuntimeError(f"strengths still change by {moved} after {ROUNDS} rounds")
