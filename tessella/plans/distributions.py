"""Queries of the set-level scorers: customers as personas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributions
from ..sources.records import table
from . import query
from .scoring import e6

VALUES = """f as (select c_custkey as persona, 'segment' as field, c_mktsegment as value from customer union all select c_custkey, 'nation', cast(c_nationkey as varchar) from customer where c_custkey % 5 > 0
  union all select c_custkey, 'rich', cast(c_acctbal > 5000 as varchar) from customer union all select c_custkey, 'home', cast(c_nationkey % 3 as varchar) from customer), z as (select count(distinct persona) as personas from f)"""
GROUPS = "g as (select c_custkey as persona, 'home' as grouping, cast(c_nationkey % 3 as varchar) as name from customer union all select c_custkey, 'rich', cast(c_acctbal > 5000 as varchar) from customer)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("persona"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_nationkey").cast("string")).alias("nation"),
        (F.col("c_acctbal") > 5000).cast("string").alias("rich"), (F.col("c_nationkey") % 3).cast("string").alias("home"),
    )
    return c.unpivot(["persona"], ["segment", "nation", "rich", "home"], "field", "value").where("value is not null")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where("field in ('home', 'rich')").select("persona", F.col("field").alias("grouping"), F.col("value").alias("name"))


@query(f"""with {VALUES}, c as (select field, value, count(*) as n from f group by 1, 2), p as (select field, n, n * 1.0 / sum(n) over (partition by field) as p from c), e as (select field, max(p) as mode, case when count(*) < 2 then 0 else -sum(p * log2(p)) / log2(greatest(count(*), 2)) end as even from p group by 1 having sum(n) >= 2),
  q as (select event_type as question_id, user_id % 3 as r, count(*) as n from events where user_id % 3 < 2 group by 1, 2), s as (select question_id, max(n) * 1.0 / sum(n) as mode from q group by 1 having sum(n) >= 3), t as (select coalesce(avg(case when mode >= 0.8 then 1.0 else 0.0 end), 0) as entrenchment from s),
  x as (select (avg(even) + avg(1 - mode)) / 2 as score, count(case when mode > 0.8 then 1 end) as collapsed from e) select collapsed, cast(round(score * 1e6) as bigint) as score_e6, collapsed = 0 and score >= 0.3 and entrenchment < 0.4 as passed, personas < 20 as skipped from x, t, z""")
def diversity_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    surveys = table(spark, sf_dir, "events").where("user_id % 3 < 2").select(F.col("event_type").alias("question_id"), (F.col("user_id") % 3).cast("string").alias("response"))
    return distributions.diversity(_values(spark, sf_dir), surveys).select("collapsed", e6(F.col("score")).alias("score_e6"), "passed", "skipped")


@query("""with f as (select c_custkey as persona, 'balance' as field, c_acctbal as v from customer union all select c_custkey, 'key', c_custkey * 1.0 from customer union all select c_custkey, 'one', 1.0 from customer), a as (select field, avg(v) as m, stddev_pop(v) as s from f group by 1 having count(*) >= 5),
  x as (select avg(case when s = 0 then 0 else least(1, case when m = 0 then 0 else s / m end / 0.3) end) as score, count(case when s = 0 then 1 end) as constant from a) select constant, cast(round(score * 1e6) as bigint) as score_e6, constant = 0 and score >= 0.3 as passed, (select count(*) < 20 from customer) as skipped from x""")
def variance_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_custkey").cast("double").alias("key"), F.lit(1.0).alias("one"))
    d = distributions.variance(c.unpivot(["persona"], ["balance", "key", "one"], "field", "number"))
    return d.select("constant", e6(F.col("score")).alias("score_e6"), "passed", "skipped")


def _divergence(left: str, right: str, by: str) -> str:
    """Mean Jensen-Shannon divergences by ``by`` of two tables of counts (by, value, n)."""
    share = lambda t: f"(select {by}, value, n * 1.0 / sum(n) over (partition by {by}) as p from {t})"
    return f"select {by}, sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2 as jsd from (select {by}, value, coalesce(a.p, 0) as p, coalesce(b.p, 0) as q from {share(left)} a full join {share(right)} b using ({by}, value)) group by {by}"


@query(f"""with {VALUES}, {GROUPS}, d as (select field, value, seed, substr(md5(cast(seed as varchar) || ':' || cast(persona as varchar)), 1, 1) < '8' as first from f, (values (0), (1), (2), (3), (4)) v(seed)),
  h1 as (select seed, field, value, count(*) as n from d where first group by 1, 2, 3), h2 as (select seed, field, value, count(*) as n from d where not first group by 1, 2, 3), s as (select seed, 1 - avg(jsd) as c from ({_divergence("h1", "h2", "seed, field")}) group by 1),
  gs as (select grouping, name from g group by 1, 2 having count(distinct persona) >= 3), ok as (select grouping from gs group by 1 having count(*) >= 2), o1 as (select g.grouping, g.name, field, value, count(*) as n from f join g using (persona) join gs on gs.grouping = g.grouping and gs.name = g.name join ok on ok.grouping = g.grouping group by 1, 2, 3, 4),
  o2 as (select grouping, name, field, value, n from (select distinct grouping, name, field from o1) k join (select field, value, count(*) as n from f group by 1, 2) a using (field)), b as (select grouping, field, 1 - avg(jsd) as c from ({_divergence("o1", "o2", "grouping, name, field")}) group by 1, 2),
  x as (select avg(c) as score, count(*) as comparisons from (select c from s union all select c from b)) select comparisons, cast(round(score * 1e5) as bigint) as score_e5, score >= 0.7 as passed, personas < 50 as skipped from x, z""")
def aggregation_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = distributions.aggregation(_values(spark, sf_dir), _groups(spark, sf_dir))
    return d.select("comparisons", F.round(F.col("score") * 1e5).cast("bigint").alias("score_e5"), "passed", "skipped")


@query(f"""with {VALUES}, k as (select value as name from f where field = 'home' group by 1 having count(*) >= 3), m as (select persona, value as name from f where field = 'home' and value in (select name from k)), c as (select name, field, value, count(*) as n from f join m using (persona) group by 1, 2, 3),
  p as (select name, field, n, n * 1.0 / sum(n) over (partition by name, field) as p from c), e as (select case when count(*) < 2 then 0 else -sum(p * log2(p)) / log2(greatest(count(*), 2)) end as even from p group by name, field having sum(n) >= 2)
  select count(*) as cells, cast(round(avg(even) * 1e6) as bigint) as score_e6, avg(even) >= 0.3 as passed, (select personas < 30 from z) as skipped from e""")
def minority_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _groups(spark, sf_dir).where("grouping = 'home'").select("persona", "name")
    return distributions.minority(_values(spark, sf_dir), groups).select("cells", e6(F.col("score")).alias("score_e6"), "passed", "skipped")


@query(f"""with {VALUES}, t as (select x.field as a, y.field as b, x.value as va, y.value as vb, count(*) * 1.0 as o from f x join f y on x.persona = y.persona and x.field < y.field group by 1, 2, 3, 4), m as (select *, sum(o) over (partition by a, b, va) as ra, sum(o) over (partition by a, b, vb) as rb from t),
  v as (select a, b, sqrt(greatest(sum(o * o / (ra * rb)) - 1, 0) / (least(count(distinct va), count(distinct vb)) - 1)) as v from m group by 1, 2 having sum(o) >= 5), x as (select avg(v) as mean_v, count(case when v > 0.7 then 1 end) as stereotypes from v),
  r as (select avg(case when (c_acctbal - 4500) * (c_acctbal - 4000) < 0 then 1.0 else 0.0 end) as flips from customer)
  select stereotypes, cast(round(mean_v * 1e5) as bigint) as mean_e5, cast(round(greatest(0, 1 - mean_v) * case when stereotypes > 0 then 0.5 else 1 end * 1e5) as bigint) as score_e5, stereotypes = 0 and mean_v < 0.5 and flips <= 0.1 as passed, cast(round(flips * 1e6) as bigint) as flips_e6, personas < 50 as skipped from x, r, z""")
def joint_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    coefficients = table(spark, sf_dir, "customer").select((F.col("c_acctbal") - 4500).alias("real"), (F.col("c_acctbal") - 4000).alias("synthetic"))
    d, e5 = distributions.joint(_values(spark, sf_dir), coefficients), lambda c: F.round(F.col(c) * 1e5).cast("bigint")
    return d.select("stereotypes", e5("mean_v").alias("mean_e5"), e5("score").alias("score_e5"), "passed", e6(F.col("sign_flips")).alias("flips_e6"), "skipped")


@query("""with p as (select 'rich' as demographic, cast(c_acctbal > 9000 as varchar) as value, c_nationkey as trait from customer union all select 'segment', c_mktsegment, c_nationkey from customer), c as (select demographic, trait, value, count(*) as n from p group by 1, 2, 3),
  t as (select max(n) * 1.0 / sum(n) as top from c group by demographic, trait having sum(n) >= 2) select count(*) as pairs, count(case when top >= 0.85 then 1 end) as tied, cast(round((1 - count(case when top >= 0.85 then 1 end) * 1.0 / count(*)) * 1e6) as bigint) as score_e6, count(case when top >= 0.85 then 1 end) = 0 as passed, count(*) = 0 as skipped from t""")
def stereotypes_of_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 9000).cast("string").alias("rich"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("trait"))
    return distributions.stereotypes(c.unpivot(["trait"], ["rich", "segment"], "demographic", "value")).select("pairs", "tied", e6(F.col("score")).alias("score_e6"), "passed", "skipped")
