"""Statistics as aggregates, safe under ANSI arithmetic."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

TINY = 1e-10


def in_order(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt by ``by``, each group in one task and by ``order``, so that a group's doubles are added one after
    the other whatever partitions they came from; without ``order`` as they are. A group passes its task as a
    stream: the sort spills, and a sum holds one row a group."""
    return rows.repartition(*by).sortWithinPartitions(*by, *order) if order else rows


def pearson0(x: Column, y: Column) -> Column:
    """Pearson's r over pairs without nulls; 0 for fewer than 2, or if either hardly varies."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a)
    spread = n * F.sqrt(F.var_pop(a) * F.var_pop(b))
    return F.when((n < 2) | (spread < TINY), 0.0).otherwise(F.try_divide(n * F.covar_pop(a, b), spread))


def shares(counts: DataFrame, by: list[str], n: str, name: str) -> DataFrame:
    """``counts`` with the share of ``n`` in its group's total as ``name``; a group isn't gathered for that, only its
    total is joined back."""
    total = counts.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.sum(n).alias("__total"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or F.lit(True)  # without groups, one row
    return counts.join(total, same).withColumn(name, F.col(n) / F.col("__total")).drop("__total", *(f"__{c}" for c in by))


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """For each group of ``by``, over its counted values: k, mode share, entropy in bits over that
    of k equal values (0 for one value), and 1 - mode share."""
    d = shares(counts, by, n, "p").groupBy(*by).agg(
        F.count("*").alias("k"), F.max("p").alias("mode_share"), (-F.sum(F.col("p") * F.log2("p"))).alias("h")
    )
    evenness = F.when(F.col("k") < 2, 0.0).otherwise(F.col("h") / F.log2(F.greatest(F.col("k"), F.lit(2))))
    return d.select(*by, "k", "mode_share", evenness.alias("evenness"), (1 - F.col("mode_share")).alias("variation"))


def jsd(left: DataFrame, right: DataFrame, key: str, by: list[str] | None = None, n: str = "n") -> DataFrame:
    """Jensen-Shannon divergence in bits of two tables of counts (``by``, key, n); a side without
    any counts gives 1, two such 0."""
    by = by or []
    share = lambda d, name: shares(d, by, n, name).select(*by, key, name)
    both = share(left, "p").join(share(right, "q"), [*by, key], "full_outer").fillna(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    out = both.groupBy(*by).agg(F.sum(term("p")).alias("__tp"), F.sum(term("q")).alias("__tq"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    value = F.when((F.col("sp") == 0) & (F.col("sq") == 0), 0.0).when((F.col("sp") == 0) | (F.col("sq") == 0), 1.0).otherwise((F.col("__tp") + F.col("__tq")) / 2)
    return out.select(*by, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("jsd"))


def average_rank(value: str, by: list[str], out: str = "rank") -> tuple[str, Column]:
    """Ranks from 1 within groups, equal values sharing the mean of theirs."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return out, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def _erf(x: pd.Series) -> pd.Series:
    return x.map(math.erf)


def normal_cdf(z: Column) -> Column:
    """Of a standard normal; Spark has no error function, so it is computed in Arrow batches."""
    return (1 + F.pandas_udf(_erf, "double")(z / math.sqrt(2))) / 2


def ks_two(values: DataFrame, value: str, side: str, sides: tuple, by: list[str] | None = None) -> DataFrame:
    """``by``, n_a, n_b, ks: the largest distance of the distributions of two sides. Values are counted
    first, and their running counts come from ranges, so no group is sorted in one task. Nulls don't
    count; where a side has no values, ks is null."""
    by = by or []
    pick = lambda x: F.count_if(F.col(side) == F.lit(x))
    c = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(pick(sides[0]).alias("a"), pick(sides[1]).alias("b")).where("a > 0 or b > 0")
    r = ranks.running(c, by, [value], "a", "b")
    gap = F.abs(F.try_divide(F.col("before_a") + F.col("a"), F.col("total_a")) - F.try_divide(F.col("before_b") + F.col("b"), F.col("total_b")))
    return r.groupBy(*by).agg(F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"), F.max(gap).alias("ks"))


def ks_normal(values: DataFrame, value: str, reference: DataFrame, by: str) -> DataFrame:
    """``by``, n, ks, p: the distance of each group's values from the normal distribution that ``reference``
    (``by``, mean, std) gives, and the chance of such a distance by Kolmogorov's series, which holds for
    many values. Groups without a reference, or with one of no spread, have no row."""
    c = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    r = ranks.running(c, [by], [value], "n").join(reference.where("std > 0"), by)
    r = r.withColumn("cdf", normal_cdf((F.col(value) - F.col("mean")) / F.col("std")))
    above = (F.col("before_n") + F.col("n")) / F.col("total_n") - F.col("cdf")
    below = F.col("cdf") - F.col("before_n") / F.col("total_n")
    d = r.groupBy(by).agg(F.max("total_n").alias("n"), F.max(F.greatest(above, below)).alias("ks"))
    t = F.col("n") * F.col("ks") * F.col("ks")
    series = reduce(lambda a, k: a + (2 if k % 2 else -2) * F.exp(-2.0 * k * k * t), range(1, 101), F.lit(0.0))
    return d.withColumn("p", F.when(t < 0.04, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))
