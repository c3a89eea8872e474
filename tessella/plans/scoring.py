"""Queries of the scorer suite."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, vectors
from ..operators import agreement, dimensions, scoring
from ..sources.records import table
from . import query


def e6(x) -> F.Column:
    return F.round(x * 1e6).cast("bigint")


def half_up(x) -> F.Column:
    """As F.round(x) to a whole number, for x of at least 0: F.round goes by decimals, which is slow for a row each pair."""
    return F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as personas, with some fields missing or odd so that rules have something to find."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    jobs = F.array(*(F.lit(x) for x in ("Senior Analyst", "Junior Clerk", "Director", "Engineer", "")))
    education = F.array(F.lit("PhD"), F.lit("High School"), F.lit("BSc"))
    return c.select(
        k.alias("persona_id"),
        F.when(k % 97 == 0, "").otherwise(F.col("c_name")).alias("name"),
        (18 + k % 60).cast("int").alias("age"),
        (k % 25).cast("int").alias("experience_years"),
        F.element_at(jobs, (k % 5 + 1).cast("int")).alias("occupation"),
        F.element_at(education, (k % 3 + 1).cast("int")).alias("education"),
        F.col("c_mktsegment").alias("industry"),
        F.concat(F.lit("nation "), F.col("c_nationkey")).alias("location"),
        F.when(k % 11 == 0, "luxury").otherwise("plain").alias("lifestyle"),
        F.when(k % 13 == 0, "tbd").otherwise(F.repeat(F.col("c_mktsegment"), 8)).alias("bio"),
        F.when(k % 7 == 0, "widowed").otherwise("married").alias("marital_status"),
        F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("income_bracket"),
        F.when(k % 19 > 0, F.array(F.lit("goals"))).alias("goals"),
        *(F.array(F.lit(x)).alias(x) for x in ("pain_points", "knowledge_domains")),
        F.when(k % 17 == 0, F.array(F.lit("introvert"))).otherwise(F.array(F.lit("curious"))).alias("personality_traits"),
        F.when(k % 5 == 0, F.array(F.lit("budget"))).otherwise(F.array(F.lit("quality"))).alias("values"),
        F.when(k % 3 == 0, F.array(F.lit("public speaking"))).otherwise(F.array().cast("array<string>")).alias("behaviors"),
    )


PERSONAS = """p as (select c_custkey as persona_id, case when c_custkey % 97 = 0 then '' else c_name end as name, 18 + c_custkey % 60 as age, c_custkey % 25 as years,
  case c_custkey % 5 when 0 then 'senior analyst' when 1 then 'junior clerk' when 2 then 'director' when 3 then 'engineer' else '' end as job,
  case c_custkey % 3 when 0 then 'phd' when 1 then 'high school' else 'bsc' end as education, c_custkey % 11 = 0 as luxury, c_custkey % 13 = 0 as tbd, length(c_mktsegment) * 8 as bio_length,
  c_custkey % 7 = 0 as widowed, c_acctbal > 5000 as high, c_custkey % 17 = 0 as introvert, c_custkey % 5 = 0 as budget, c_custkey % 3 = 0 as speaks, c_custkey % 19 = 0 as no_goals from customer)"""


@query(f"with {PERSONAS} select cast(persona_id as varchar) as persona_id, name <> '' and not no_goals as passed, cast(1000000 - 200000 * ((case when name = '' then 1 else 0 end) + (case when no_goals then 1 else 0 end)) as bigint) as score_e6 from p")
def schema_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.schema_compliance(personas(spark, sf_dir)).select("persona_id", "passed", e6(F.col("score")).alias("score_e6"))


@query(f"""with {PERSONAS}, e as (select persona_id, (case when name = '' then 1 else 0 end) + (case when job = '' then 1 else 0 end) + (case when tbd or bio_length < 50 then 1 else 0 end) + (case when speaks then 0 else 1 end) + (case when no_goals then 1 else 0 end) as n from p)
  select cast(persona_id as varchar) as persona_id, n = 0 as passed, cast(round((1 - n / 13.0) * 1e6) as bigint) as score_e6 from e""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.completeness(personas(spark, sf_dir)).select("persona_id", "passed", e6(F.col("score")).alias("score_e6"))


@query(f"""with {PERSONAS}, e as (select persona_id, (case when job in ('senior analyst', 'director') and years < 3 then 1 else 0 end) + (case when job = 'junior clerk' and years > 10 then 1 else 0 end)
  + (case when age - years < 14 then 1 else 0 end) + (case when budget and luxury then 1 else 0 end) + (case when introvert and speaks then 1 else 0 end) as n from p)
  select cast(persona_id as varchar) as persona_id, n = 0 as passed, cast(round(greatest(0, 1 - n * 0.25) * 1e6) as bigint) as score_e6 from e""")
def consistency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.consistency(personas(spark, sf_dir)).select("persona_id", "passed", e6(F.col("score")).alias("score_e6"))


@query(f"""with {PERSONAS}, e as (select persona_id, (case when education = 'phd' and age < 24 then 1 else 0 end) + (case when job = 'director' and age < 25 then 1 else 0 end) + (case when widowed and age < 25 then 1 else 0 end)
  + (case when education = 'high school' and high and age < 30 then 1 else 0 end) + (case when years > age - 16 then 1 else 0 end) as n from p)
  select cast(persona_id as varchar) as persona_id, n = 0 as passed, cast(round((5 - n) / 5.0 * 1e6) as bigint) as score_e6 from e""")
def demographic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.demographic_coherence(personas(spark, sf_dir)).select("persona_id", "passed", e6(F.col("score")).alias("score_e6"))


_SUITE = f"""{PERSONAS}, x as (select persona_id, name <> '' and not no_goals as d1,
    name <> '' and job <> '' and not tbd and bio_length >= 50 and speaks and not no_goals as d2,
    not (job in ('senior analyst', 'director') and years < 3) and not (job = 'junior clerk' and years > 10) and age - years >= 14 and not (budget and luxury) and not (introvert and speaks) as d3,
    not (education = 'phd' and age < 24) and not (job = 'director' and age < 25) and not (widowed and age < 25) and not (education = 'high school' and high and age < 30) and years <= age - 16 as d7 from p),
  g as (select *, d1 and d2 and d3 as ok from x), s as (select 'D1' as dimension_id, 1 as tier, d1 as passed, false as skipped from g union all select 'D2', 1, d2, false from g union all select 'D3', 1, d3, false from g union all select 'D7', 2, ok and d7, not ok from g)"""


@query(f"with {_SUITE} select dimension_id, tier, count(*) as n, count(case when passed then 1 end) as passed, count(case when skipped then 1 end) as skipped from s group by 1, 2")
def suite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-persona suite with tier gating, counted by dimension."""
    p = personas(spark, sf_dir)
    rows = scoring.suite([scoring.schema_compliance, scoring.completeness, scoring.consistency, scoring.demographic_coherence], p)
    return rows.groupBy("dimension_id", "tier").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("skipped").alias("skipped"))


@query(f"""with {_SUITE}, v as (select avg(case when high then 1.0 else 0.0 end) as r from p), f as (select not bool_and(d1 and d2 and d3) as failed from g),
  a as (select dimension_id, tier, passed, skipped from s union all select 'D35', 6, r >= 0.6 and not failed, failed from v, f)
  select dimension_id, tier, count(*) as n, count(case when passed then 1 end) as passed, count(case when skipped then 1 end) as skipped from a group by 1, 2""")
def suite_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a scorer of the set, which the gate closes."""
    p = personas(spark, sf_dir)
    guessed = dimensions.role_identifiability(p.select(F.lit(True).alias("truth"), (F.col("income_bracket") == "high").alias("guess")))
    rows = scoring.suite_full([scoring.schema_compliance, scoring.completeness, scoring.consistency, scoring.demographic_coherence], [scoring.set_result(guessed, "D35", "Role Identifiability", 6)], p)
    return rows.groupBy("dimension_id", "tier").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("skipped").alias("skipped"))


FIELDS = "f as (select 'segment' as field, c_mktsegment as v from customer union all select 'nation', cast(c_nationkey as varchar) from customer union all select 'high', cast(c_acctbal > 5000 as varchar) from customer)"


@query(f"""with {FIELDS}, c as (select field, v, count(*) as n from f group by field, v), p as (select field, n * 1.0 / sum(n) over (partition by field) as p from c),
  a as (select field, count(*) as k, max(p) as mode, -sum(p * log2(p)) as h from p group by field)
  select field, k, cast(round(mode * 1e6) as bigint) as mode_e6, cast(round((case when k < 2 then 0 else h / log2(greatest(k, 2)) end + 1 - mode) / 2 * 1e6) as bigint) as score_e6 from a""")
def opinion_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), (F.col("c_acctbal") > 5000).cast("string").alias("high"))
    d = scoring.opinion_diversity(c.unpivot([], ["segment", "nation", "high"], "field", "v"), ["field"], "v")
    return d.select("field", "k", e6(F.col("mode_share")).alias("mode_e6"), e6(F.col("score")).alias("score_e6"))


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by c_nationkey, c_mktsegment), p as (select c_nationkey, n * 1.0 / sum(n) over (partition by c_nationkey) as p from c)
  select c_nationkey, count(*) as k, cast(round(case when count(*) < 2 then 0 else -sum(p * log2(p)) / log2(greatest(count(*), 2)) end * 1e6) as bigint) as evenness_e6 from p group by c_nationkey""")
def minority_viewpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return stats.entropy(c, ["c_nationkey"]).select("c_nationkey", "k", e6(F.col("evenness")).alias("evenness_e6"))


def _jsd_sql(side: str) -> str:
    return f"""{side}, t as (select side, v, count(*) * 1.0 as n from x group by side, v), s as (select side, v, n / sum(n) over (partition by side) as p from t),
  j as (select coalesce(a.v, b.v) as v, coalesce(a.p, 0) as p, coalesce(b.p, 0) as q from (select * from s where side = 0) a full join (select * from s where side = 1) b on a.v = b.v)
  select cast(round(sum(case when p > 0 then p * log2(p * 2 / (p + q)) else 0 end + case when q > 0 then q * log2(q * 2 / (p + q)) else 0 end) / 2 * 1e6) as bigint) as jsd_e6 from j"""


@query("with " + _jsd_sql("x as (select case when substr(md5(cast(c_custkey as varchar)), 1, 1) < '8' then 0 else 1 end as side, c_mktsegment as v from customer)"))
def split_half_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select((F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1) < "8").alias("first"), F.col("c_mktsegment").alias("v"))
    half = lambda k: c.where(k).groupBy("v").agg(F.count("*").alias("n"))
    return stats.jsd(half("first"), half("not first"), "v").select(e6(F.col("jsd")).alias("jsd_e6"))


@query("""with t as (select o_orderpriority as a, o_orderstatus as b, count(*) * 1.0 as o from orders group by 1, 2), m as (select o, sum(o) over (partition by a) as ra, sum(o) over (partition by b) as rb, a, b from t),
  s as (select sum(o * o / (ra * rb)) as s, sum(o) as n, least(count(distinct a), count(distinct b)) - 1 as k from m)
  select cast(n as bigint) as n, cast(round(sqrt(greatest(s - 1, 0) / nullif(k, 0)) * 1e6) as bigint) as v_e6 from s""")
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cramers_v(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus").select("n", e6(F.col("v")).alias("v_e6"))


CONFIDENCE = "x as (select least(1.0, d.n_chars / 4000.0) as conf, l.quality from labels l join documents d on d.doc_id = l.doc_id)"


@query(f"""with {CONFIDENCE} select cast(greatest(ceil(conf * 10), 1) as integer) as bin, count(*) as n, cast(round(avg(conf) * 1e6) as bigint) as confidence_e6, cast(round(avg(quality) * 1e6) as bigint) as accuracy_e6 from x group by 1""")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = agreement.calibration_bins(_rated(spark, sf_dir), "conf", "quality")
    return b.select("bin", "n", e6(F.col("confidence")).alias("confidence_e6"), e6(F.col("accuracy")).alias("accuracy_e6"))


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("conf"), "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id")


@query("""select cast(round(least(1.0, case when avg(c_acctbal) = 0 then 0 else stddev_pop(c_acctbal) / abs(avg(c_acctbal)) end / 0.3) * 1e6) as bigint) as fidelity_e6,
  cast(round((quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) * 1e4) as bigint) as iqr_e4, c_mktsegment from customer group by c_mktsegment""")
def variance_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = F.try_divide(F.stddev_pop("c_acctbal"), F.abs(F.avg("c_acctbal")))
    iqr = F.percentile("c_acctbal", F.lit(0.75)) - F.percentile("c_acctbal", F.lit(0.25))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(e6(F.least(F.lit(1.0), F.coalesce(cv, F.lit(0.0)) / 0.3)).alias("fidelity_e6"), F.round(iqr * 1e4).cast("bigint").alias("iqr_e4"))


@query("""with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), g as (select c_nationkey, sum(n) as total, max(n) as top from c group by 1 having sum(n) >= 2)
  select c_nationkey, cast(total as bigint) as total, top, top >= 0.85 * total as flagged from g""")
def stereotype_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    g = c.groupBy("c_nationkey").agg(F.sum("n").alias("total"), F.max("n").alias("top")).where("total >= 2")
    return g.withColumn("flagged", F.col("top") >= 0.85 * F.col("total"))


@query("""with t as (select conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from conversations)
  select conv_id, count(*) as n, count(distinct w) as k, cast(round(count(distinct w) * 1e6 / count(*)) as bigint) as ttr_e6 from t group by conv_id""")
def engagement_ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    d = w.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("w").alias("k"))
    return d.withColumn("ttr_e6", e6(F.col("k") / F.col("n")))


UNNEST = "u as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), n as (select vec_id, sqrt(sum(cast(x as double) * x)) + 1e-10 as norm from u group by vec_id)"


@query(f"""with {UNNEST}, s as (select label, i, sum(cast(x as double) / norm) as s, count(*) as n from u join n using (vec_id) group by label, i), q as (select label, max(n) as n, sum(s * s) as q from s group by label)
  select label, n, cast(round((q - n) / (n * (n - 1.0)) * 1e5) as bigint) as cosine_e5, cast(round(sqrt(q) / n * 1e5) as bigint) as radius_e5 from q where n > 1""")
def behavioral_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.mean_pairwise_cosine(table(spark, sf_dir, "embeddings"), ["label"], "embedding").where("n > 1")
    return d.select("label", "n", F.round(F.col("mean_cosine") * 1e5).cast("bigint").alias("cosine_e5"), F.round(F.col("radius") * 1e5).cast("bigint").alias("radius_e5"))


@query(f"""with {UNNEST}, r as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as at, count(*) over (partition by label) as total from embeddings),
  w as (select label, unnest(generate_series(0, cast(floor((max(total) - 10) / 5.0) as bigint))) as win from r group by label having max(total) >= 10), m as (select w.label, w.win, r.vec_id from w join r on r.label = w.label and r.at between w.win * 5 and w.win * 5 + 9),
  x as (select m.label, m.win, m.vec_id, i, cast(x as double) as x, norm from m join u on u.vec_id = m.vec_id join n on n.vec_id = m.vec_id), c as (select label, win, i, avg(x) as c from x group by 1, 2, 3), l as (select label, win, sqrt(sum(c * c)) + 1e-10 as cn from c group by 1, 2),
  s as (select x.label, x.win, x.vec_id, sum(x.x / x.norm * c.c) as s from x join c on c.label = x.label and c.win = x.win and c.i = x.i group by 1, 2, 3)
  select s.label, cast(s.win as integer) as "window", count(*) as n, cast(round(avg(s / cn) * 1e5) as bigint) as coherence_e5 from s join l on l.label = s.label and l.win = s.win group by 1, 2""")
def coherence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.sliding_coherence(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", ["label"])
    return d.select("label", "window", "n", F.round(F.col("coherence") * 1e5).cast("bigint").alias("coherence_e5"))


@query(f"""with {UNNEST}, r as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as at, count(*) over (partition by label) as total from embeddings),
  w as (select label, unnest(generate_series(0, cast(floor((max(total) - 10) / 5.0) as bigint))) as win from r group by label having max(total) >= 10), m as (select w.label, w.win, r.vec_id from w join r on r.label = w.label and r.at between w.win * 5 and w.win * 5 + 9),
  x as (select m.label, m.win, m.vec_id, i, cast(x as double) as x, norm from m join u on u.vec_id = m.vec_id join n on n.vec_id = m.vec_id), c as (select label, win, i, avg(x) as c from x group by 1, 2, 3), l as (select label, win, sqrt(sum(c * c)) + 1e-10 as cn from c group by 1, 2),
  s as (select x.label, x.win, x.vec_id, sum(x.x / x.norm * c.c) as s from x join c on c.label = x.label and c.win = x.win and c.i = x.i group by 1, 2, 3),
  y as (select s.label, s.win, round(avg(s / cn), 4) as c from s join l on l.label = s.label and l.win = s.win group by 1, 2), k as (select label, count(*) as k from y group by 1), t as (select label, count(*) as n from embeddings group by 1),
  d as (select y.label, max(k) as k, avg(c) as mean, avg(case when win < floor(k / 2.0) then c end) - avg(case when win >= floor(k / 2.0) then c end) as decay, min(case when c < 0.7 then win * 5 end) as critical from y join k on k.label = y.label group by 1)
  select t.label as persona_id, case when n < 20 or coalesce(k, 0) < 2 then null else cast(round(decay * 1e4) as bigint) end as decay_e4, case when n < 20 or coalesce(k, 0) < 2 then null else cast(critical as bigint) end as critical_turn,
  case when n < 20 or coalesce(k, 0) < 2 then 10000 else cast(round(least(1, mean) * 1e4) as bigint) end as score_e4, case when n < 20 or coalesce(k, 0) < 2 then true else decay < 0.1 and mean >= 0.6 end as passed, n < 20 or coalesce(k, 0) < 2 as skipped from t left join d on d.label = t.label""")
def coherence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D34 of embeddings by label."""
    e = table(spark, sf_dir, "embeddings").withColumn("persona_id", F.col("label"))
    d = dimensions.coherence_decay(scoring.sliding_coherence(e, "vec_id", "embedding", ["persona_id"]), e.groupBy("persona_id").agg(F.count("*").alias("n")))
    return d.select("persona_id", F.round(F.col("decay") * 1e4).cast("bigint").alias("decay_e4"), F.col("critical_turn").cast("bigint").alias("critical_turn"), F.round(F.col("score") * 1e4).cast("bigint").alias("score_e4"), "passed", "skipped")


@query(f"""with {UNNEST}, v as (select u.vec_id, label, i, cast(x as double) / norm as x from u join n on u.vec_id = n.vec_id),
  p as (select q.vec_id as query_id, c.vec_id as match_id, sum(q.x * c.x) as s from v q join v c on q.i = c.i and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by round(s, 7) desc, match_id) as rank from p) select query_id, match_id, rank from r where rank <= 5""")
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each stated query."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    d = vectors.nearest(e.withColumnRenamed("vec_id", "match_id"), "match_id", "embedding", q, "query_id", "qv", 5, digits=7)
    return d.select("query_id", "match_id", F.col("rank").cast("bigint").alias("rank"))


@query("""with x as (select ts >= timestamp '2024-01-16 00:00:00' as late, cast(floor(value / 50) as integer) as bin, count(*) * 1.0 as n from events group by 1, 2),
  b as (select bin, n / sum(n) over () as b from x where not late), c as (select bin, n / sum(n) over () as c from x where late),
  j as (select greatest(coalesce(b, 0), 1e-6) as b, greatest(coalesce(c, 0), 1e-6) as c from b full join c on b.bin = c.bin) select cast(round(sum((c - b) * ln(c / b)) * 1e6) as bigint) as psi_e6 from j""")
def stability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")).alias("late"), F.floor(F.col("value") / 50).alias("bin"))
    half = lambda k: e.where(k).groupBy("bin").agg(F.count("*").alias("n"))
    return scoring.psi(half("not late"), half("late"), "bin").select(e6(F.col("psi")).alias("psi_e6"))


@query("""with m as (select event_type as dimension, user_id % 4 as model, avg(value) as s from events group by 1, 2) select dimension, cast(round((max(s) - min(s)) * 1e4) as bigint) as range_e4, count(*) as models from m group by 1""")
def cross_model_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dimension"), (F.col("user_id") % 4).alias("model")).agg(F.avg("value").alias("s"))
    return m.groupBy("dimension").agg(F.round((F.max("s") - F.min("s")) * 1e4).cast("bigint").alias("range_e4"), F.count("*").alias("models"))


@query("""with d as (select event_type, cast(ts as date) as day, avg(value) as s from events group by 1, 2), h as (select event_type, day, s, count(*) over w as n, avg(s) over w as m, stddev_pop(s) over w as sd from d
  window w as (partition by event_type order by day rows between unbounded preceding and 1 preceding)) select event_type, strftime(day, '%Y-%m-%d') as day, n, cast(round(case when n < 5 then 0 else (s - m) / greatest(sd, 0.01) end * 1e4) as bigint) as z_e4 from h""")
def degradation_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("s"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    z = F.when(F.col("n") < 5, 0.0).otherwise((F.col("s") - F.col("m")) / F.greatest(F.col("sd"), F.lit(0.01)))
    h = d.select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "s", F.count("*").over(w).alias("n"), F.avg("s").over(w).alias("m"), F.stddev_pop("s").over(w).alias("sd"))
    return h.select("event_type", "day", "n", F.round(z * 1e4).cast("bigint").alias("z_e4"))


@query("""select l_returnflag, count(*) as n, cast(round(coalesce(corr(l_quantity, l_extendedprice), 0) * 1e6) as bigint) as r_e6 from lineitem group by l_returnflag""")
def predictive_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.pearson0(F.col("l_quantity"), F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), e6(r).alias("r_e6"))


@query("""with x as (select c_mktsegment, c_acctbal as a, length(c_name) + c_nationkey as b from customer), r as (select c_mktsegment, rank() over (partition by c_mktsegment order by a) + (count(*) over (partition by c_mktsegment, a) - 1) / 2.0 as ra,
  rank() over (partition by c_mktsegment order by b) + (count(*) over (partition by c_mktsegment, b) - 1) / 2.0 as rb from x) select c_mktsegment, count(*) as n, cast(round(coalesce(corr(ra, rb), 0) * 1e6) as bigint) as rho_e6 from r group by 1""")
def spearman_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("a"), (F.length("c_name") + F.col("c_nationkey")).alias("b"))
    return agreement.spearman(d, ["c_mktsegment"], "a", "b").select("c_mktsegment", "n", e6(F.col("rho")).alias("rho_e6"))


@query("""with t as (select quality as a, 1 - toxic as b from labels), n as (select count(*) as n, sum(case when a = b then 1 else 0 end) as same from t),
  c as (select sum(x.n * y.n) as c from (select a as v, count(*) as n from t group by a) x join (select b as v, count(*) as n from t group by b) y on x.v = y.v)
  select n, cast(round((same * 1.0 / n - c * 1.0 / (n * n)) / (1 - c * 1.0 / (n * n)) * 1e6) as bigint) as kappa_e6 from n, c""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return agreement.cohen_kappa(t, "a", "b").select("n", e6(F.col("kappa")).alias("kappa_e6"))


@query("""with r as (select doc_id as item, quality as v from labels union all select doc_id, 1 - toxic from labels), c as (select item, v, count(*) as n from r group by 1, 2), m as (select *, sum(n) over (partition by item) as m from c),
  s as (select sum(n * (m - n) * 1.0 / (m - 1)) as d, sum(n) as total from m), h as (select sum(nv * nv) as sq from (select v, sum(n) as nv from m group by v))
  select cast(total as bigint) as total, cast(round((1 - d / ((total * total - sq) * 1.0 / (total - 1))) * 1e6) as bigint) as alpha_e6 from s, h""")
def krippendorff_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels")
    r = x.select(F.col("doc_id").alias("item"), F.col("quality").alias("v")).unionByName(x.select(F.col("doc_id").alias("item"), (1 - F.col("toxic")).alias("v")))
    return agreement.krippendorff_alpha(r, "item", "v").select("total", e6(F.col("alpha")).alias("alpha_e6"))


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, f) as k, sum(n) over (partition by user_id) as total from c)
  select user_id, event_type as vote, cast(total as bigint) as n from r where k = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.majority(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("""with x as (select d.lang, l.quality = 1 as t, d.n_chars > 500 as g from labels l join documents d on l.doc_id = d.doc_id), c as (select lang, count(case when t and g then 1 end) as tp, count(case when not t and g then 1 end) as fp, count(case when t and not g then 1 end) as fn, count(case when not t and not g then 1 end) as tn from x group by lang)
  select *, cast(round(tp * 1e6 / nullif(tp + fp, 0)) as bigint) as precision_e6, cast(round(tp * 1e6 / nullif(tp + fn, 0)) as bigint) as recall_e6 from c""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") > 500).alias("g"))
    x = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("t")).join(d, "doc_id")
    return agreement.precision_recall(x, "t", "g", ["lang"]).select("lang", "tp", "fp", "fn", "tn", e6(F.col("precision")).alias("precision_e6"), e6(F.col("recall")).alias("recall_e6"))


@query("""with m as (select event_type as dimension, user_id % 4 as judge, avg(value / 500) as m from events group by 1, 2), d as (select dimension, avg(m) as mean, stddev_samp(m) as sd, max(m) - min(m) as spread from m group by 1)
  select dimension, cast(round(mean * 1e5) as bigint) as mean_e5, cast(round(sd * 1e5) as bigint) as std_e5, case when sd >= 0.1 or spread >= 0.2 then 'low' when sd >= 0.05 or spread >= 0.1 then 'medium' else 'high' end as agreement from d""")
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("dimension"), (F.col("user_id") % 4).alias("judge"), (F.col("value") / 500).alias("s"))
    d = agreement.judge_spread(e, "dimension", "judge", "s")
    return d.select("dimension", F.round(F.col("mean") * 1e5).cast("bigint").alias("mean_e5"), F.round(F.col("std") * 1e5).cast("bigint").alias("std_e5"), "agreement")


@query("""select c_custkey, cast(round(coalesce((c_acctbal - avg(c_acctbal) over w) / coalesce(stddev_samp(c_acctbal) over w, 1), 0) * 1e5) as bigint) as z_e5 from customer window w as (partition by c_nationkey)""")
def tenant_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.zscores(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round(F.col("z") * 1e5).cast("bigint").alias("z_e5"))
