"""How alike two clusterings are, and how stable one is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(n: str) -> Column:
    return F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)


def adjusted_rand(labels: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``by``, n, ari over rows that have both labels: agreement of pairs, 0 by chance and 1 for one
    clustering under two names. From the contingency table: rows are never paired. Two clusterings
    that leave chance nothing (all in one cluster, or each alone, in both) agree wholly."""
    by = by or []
    cells = labels.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("n"))
    both = cells.groupBy(*by).agg(F.sum("n").alias("n"), _pairs("n").alias("s"))
    side = lambda c, name: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(_pairs("n").alias(name))
    d = both
    for s in (side(a, "sa"), side(b, "sb")):
        d = d.join(s, by) if by else d.join(s, F.lit(True))  # one row each
    chance = F.try_divide(F.col("sa") * F.col("sb"), F.col("n").cast("double") * (F.col("n") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(F.coalesce(most == chance, F.lit(True)), 1.0).otherwise(F.try_divide(F.col("s") - chance, most - chance))
    return d.where("n > 0").select(*by, "n", ari.alias("ari"))


def stability(users: DataFrame, cluster: Callable[[DataFrame], DataFrame], share: float = 0.8, runs: int = 5, key: str = "user_id", by: str = "tenant_id") -> DataFrame:
    """``by``, run, n, ari: the clusters (``by``, cluster, ``key``) of a share of the users, drawn by hash for each
    run, against those of all, over users that have a cluster in both."""
    whole = cluster(users).select(by, key, F.col("cluster").alias("a"))
    out = None
    for run in range(runs):
        drawn = F.pmod(F.xxhash64(F.lit(run), F.col(by), F.col(key)), F.lit(10_000)) < int(10_000 * share)
        part = cluster(users.where(drawn)).select(by, key, F.col("cluster").alias("b"))
        r = adjusted_rand(whole.join(part, [by, key]), "a", "b", [by]).select(by, F.lit(run).alias("run"), "n", "ari")
        out = r if out is None else out.unionByName(r)
    return out
