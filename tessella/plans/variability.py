"""Queries of judges' variability, entailment and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import variability
from ..sources.records import placed, table
from . import query
from .scoring import e6

SCORES = "s as (select 'n' || cast(c_nationkey as varchar) as persona_id, c_mktsegment as dimension, avg(c_acctbal) as score from customer group by 1, 2)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as personas, market segments as dimensions."""
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("persona_id"), F.col("c_mktsegment").alias("dimension"))
    return c.agg(F.avg("c_acctbal").cast("double").alias("score"))


@query(f"""with {SCORES}, v as (select 'all' as level, '' as name, count(*) as n, stddev_pop(score) / avg(score) as cv from s union all select 'persona', persona_id, count(*), case when avg(score) = 0 then 0 else stddev_pop(score) / avg(score) end from s group by persona_id
  union all select 'dimension', dimension, count(*), case when avg(score) = 0 then 0 else stddev_pop(score) / avg(score) end from s group by dimension) select level, name, n, cast(round(cv * 1e6) as bigint) as cv_e6 from v""")
def score_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variability.variation(_scores(spark, sf_dir)).select("level", "name", "n", e6(F.col("cv")).alias("cv_e6"))


@query(f"""with {SCORES}, v as (select persona_id, dimension, score > 4500 as verdict from s) select x.persona_id as a, y.persona_id as b, count(*) as dimensions, count(case when x.verdict <> y.verdict then 1 end) as different,
  cast(round(count(case when x.verdict <> y.verdict then 1 end) * 1.0 / count(*) * 1e6) as bigint) as rate_e6 from v x join v y on x.dimension = y.dimension and x.persona_id < y.persona_id group by 1, 2""")
def discrimination_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _scores(spark, sf_dir).select("persona_id", "dimension", (F.col("score") > 4500).alias("verdict"))
    return variability.discrimination(v).withColumn("rate_e6", e6(F.col("rate"))).drop("rate")


@query("""with r as (select o_orderkey % 2 as setting, o_orderpriority as dimension, o_orderkey % 9 + 1.0 as score from orders), x as (select setting, dimension, count(*) as n, avg(score) as m, stddev_pop(score) as d, max(score) - min(score) as s from r group by 1, 2
  union all select setting, null, count(*), avg(score), stddev_pop(score), max(score) - min(score) from r group by 1) select setting, dimension, n, cast(round(m * 1e6) as bigint) as mean_e6, cast(round(d * 1e6) as bigint) as deviation_e6, cast(round(s) as bigint) as spread from x""")
def retest_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).alias("setting"), F.col("o_orderpriority").alias("dimension"), (F.col("o_orderkey") % 9 + 1).cast("double").alias("score"))
    return variability.retest(o).select("setting", "dimension", "n", e6(F.col("mean")).alias("mean_e6"), e6(F.col("deviation")).alias("deviation_e6"), F.round("spread").cast("bigint").alias("spread"))


@query("""with e as (select l_suppkey as persona_id, case l_linenumber % 3 when 0 then 'entailed' when 1 then 'neutral' else 'contradicted' end as label, l_returnflag <> 'R' as grounded, cast(l_quantity as double) / 50 as c from lineitem),
  x as (select persona_id, count(*) as claims, count(case when label = 'entailed' then 1 end) as e, count(case when label = 'contradicted' then 1 end) as k, count(case when grounded then 1 end) as v, count(case when grounded and label <> 'entailed' then 1 end) as w, avg(c) as c from e group by 1)
  select persona_id, claims, cast(round(e * 1.0 / claims * 1e6) as bigint) as entailed_e6, cast(round(k * 1.0 / claims * 1e6) as bigint) as contradicted_e6, cast(round(v * 1.0 / claims * 1e6) as bigint) as coverage_e6, cast(round(coalesce(w * 1.0 / nullif(v, 0), 0) * 1e6) as bigint) as false_positive_e6, cast(round(c * 1e5) as bigint) as confidence_e5 from x""")
def entailment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    e = placed(table(spark, sf_dir, "lineitem")).select(F.col("l_suppkey").alias("persona_id"), F.when(n == 0, "entailed").when(n == 1, "neutral").otherwise("contradicted").alias("label"), (F.col("l_returnflag") != "R").alias("grounded"), (F.col("l_quantity").cast("double") / 50).alias("confidence"), "place")
    d = variability.entailment(e, ("place",))
    return d.select("persona_id", "claims", e6(F.col("entailed_rate")).alias("entailed_e6"), e6(F.col("contradicted_rate")).alias("contradicted_e6"), e6(F.col("coverage")).alias("coverage_e6"), e6(F.col("false_positive_rate")).alias("false_positive_e6"), F.round(F.col("confidence") * 1e5).cast("bigint").alias("confidence_e5"))


@query("""with w as (select distinct item_id, word from (select item_id, lower(trim(unnest(string_split(text, ' ')))) as word from benchmark) where word <> ''), n as (select item_id, count(*) as n from w group by 1),
  p as (select x.item_id as a, y.item_id as b, count(*) as s from w x join w y on x.word = y.word and x.item_id < y.item_id group by 1, 2), j as (select sum(s * 1.0 / (m.n + k.n - s)) as j from p join n m on m.item_id = a join n k on k.item_id = b),
  t as (select count(*) as total, count(case when k = 1 then 1 end) as u from (select word, count(*) as k from w group by 1)), z as (select count(*) as personas from n)
  select personas, cast(round(j / (personas * (personas - 1) / 2.0) * 1e6) as bigint) as jaccard_e6, cast(round(u * 1.0 / total * 1e6) as bigint) as unique_e6, total, total - u as shared from j, t, z""")
def vocabulary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("persona_id"), F.explode(F.split("text", " ")).alias("word"))
    return variability.vocabulary_overlap(b).select("personas", e6(F.col("mean_jaccard")).alias("jaccard_e6"), e6(F.col("unique_ratio")).alias("unique_e6"), "total", "shared")
