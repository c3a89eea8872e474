"""Queries of bronze records, pages, scalars, and the remaining scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import agreement, bronze, dimensions
from ..sources import html
from ..sources.records import placed, table
from . import query
from . import scoring as scoring_plans
from .scoring import e6


def bronze_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as message records, some of them broken."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 10 + F.col("turn")
    return bronze.widen(
        c.select(
            F.when(k % 29 == 0, "note").otherwise("message").alias("record_type"),
            F.when(k % 31 == 0, " ").otherwise("forum").alias("platform"),
            F.lit("run1").alias("crawl_run_id"),
            F.concat(F.lit("m"), k).alias("message_id"),
            F.concat(F.lit("t"), "conv_id").alias("thread_id"),
            F.lit("c1").alias("community_id"),
            F.when(F.col("role") != "system", F.col("role")).alias("author_platform_user_id"),
            F.col("text").alias("body"),
            F.when(k % 7 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z").alias("created_at"),
            F.lit("2024-01-02T00:00:00Z").alias("observed_at"),
            F.when(F.col("turn") > 0, F.concat(F.lit("m"), k - 1)).alias("reply_to_message_id"),
        )
    )


@query("""with b as (select conv_id * 10 + turn as k, role, text from conversations) select 'm' || cast(k as varchar) as message_id,
  (case when k % 31 = 0 then 1 else 0 end) + (case when k % 29 = 0 then 1 else (case when role = 'system' then 1 else 0 end) + (case when trim(text) = '' then 1 else 0 end) + (case when k % 7 = 0 then 1 else 0 end) end) as n_errors from b""")
def bronze_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bronze.errors(bronze_messages(spark, sf_dir)).select("message_id", F.size("errors").alias("n_errors"))


@query()
def bronze_flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = bronze.flat_records(bronze_messages(spark, sf_dir), "t1")
    return f.select("record_id", "source", "user_id", "timestamp", F.array_join("behaviors", ",").alias("behaviors"), F.array_join("pages", ",").alias("pages"))


@query()
def html_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = html.page_messages(table(spark, sf_dir, "pages"))
    return m.select("page_id", "number", "kind", "message_id", F.length("body").alias("n_chars"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 30 when 1 then 70 when 2 then 42 else null end as age, case c_custkey % 3 when 0 then 'male' when 1 then '' else 'female' end as gender,
  cast(round(case c_custkey % 3 when 0 then c_custkey * 0.000015 + 100 * 0.000075 when 1 then c_custkey * 0.000001 + 100 * 0.000005 else c_custkey * 0.000003 + 100 * 0.000015 end * 1e6) as bigint) as cost_e6,
  cast(round((case c_custkey % 3 when 0 then 4 when 1 then 2 else 3 end - 1) / 4.0 * 1e6) as bigint) as score_e6 from customer""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % n + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        scalars.age_midpoint(pick(4, "25-35", "65+", "42", "old")).alias("age"),
        scalars.gender(pick(3, "Predominantly male", "Mixed", "mostly female")).alias("gender"),
        e6(scalars.cost_usd(pick(3, "x-opus", "Haiku-2", "other"), k, F.lit(100))).alias("cost_e6"),
        e6(scalars.unit_score(scalars.judge_score(pick(3, '{"score": 4}', "I would say 2 of 5", "none")))).alias("score_e6"),
    )


@query("""with w as (select doc_id, len(regexp_extract_all(text, '\\S+')) as n from documents) select doc_id, cast(ceil(n / 512.0) as bigint) as chunks, n as words from w""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != "")).cast("bigint")
    return d.select("doc_id", F.size(scalars.word_chunks(F.col("text"))).cast("bigint").alias("chunks"), words.alias("words"))


@query("""with x as (select c_nationkey as persona_id, 'segment' as field, c_mktsegment as v, 'we are in ' || lower(case when c_custkey % 3 = 0 then 'nothing' else c_mktsegment end) as answer from customer)
  select persona_id, count(*) as n, cast(round(avg(case when contains(answer, lower(v)) then 1.0 else 0.0 end) * 1e6) as bigint) as score_e6, avg(case when contains(answer, lower(v)) then 1.0 else 0.0 end) >= 0.8 as passed from x group by persona_id""")
def memory_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("f"), F.col("c_custkey"))
    facts = c.select(F.col("c_nationkey").alias("persona_id"), key.alias("field"), F.col("c_mktsegment").alias("value"))
    said = F.when(F.col("c_custkey") % 3 == 0, "nothing").otherwise(F.lower("c_mktsegment"))
    answers = c.select(F.col("c_nationkey").alias("persona_id"), key.alias("field"), F.concat(F.lit("we are in "), said).alias("answer"))
    return dimensions.memory_consistency(facts, answers).select("persona_id", "n", e6(F.col("score")).alias("score_e6"), "passed")


@query("""with g as (select o_custkey as persona_id, o_totalprice / 1e5 as r, 0.5 as a, case when o_orderkey % 10 = 0 then 0.5 else 3.0 end as o from orders), s as (select persona_id, (avg(case when o = a then 0.0 else (r - a) / (o - a) end) + 1) / 2 as s from g group by 1)
  select persona_id, cast(round(greatest(0, least(1, s)) * 1e5) as bigint) as score_e5, greatest(0, least(1, s)) >= 0.2 as passed from s""")
def strategic_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = placed(table(spark, sf_dir, "orders")).select(
        F.col("o_custkey").alias("persona_id"), (F.col("o_totalprice") / 1e5).alias("result"), F.lit(0.5).alias("random"), F.when(F.col("o_orderkey") % 10 == 0, 0.5).otherwise(3.0).alias("optimal"), "place"
    )
    return dimensions.strategic_reasoning(g, ("place",)).select("persona_id", F.round(F.col("score") * 1e5).cast("bigint").alias("score_e5"), "passed")


@query("""with l as (select c_mktsegment as persona_id, c_nationkey as level, avg(c_acctbal) / 1e4 as v from customer group by 1, 2), r as (select *, v > lag(v) over (partition by persona_id order by level) as rise from l)
  select persona_id, cast(round((arg_min(v, level) - arg_max(v, level)) * 1e5) as bigint) as drop_e5, not coalesce(bool_or(rise), false) as monotone from r group by persona_id""")
def detail_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("persona_id"), F.col("c_nationkey").alias("level")).agg((F.avg("c_acctbal") / 1e4).alias("v"))
    d = dimensions.degradation(levels, ["persona_id"], "level", "v", 0.10)
    return d.select("persona_id", F.round(F.col("drop") * 1e5).cast("bigint").alias("drop_e5"), "monotone")


@query("""with f as (select l_suppkey as persona_id, l_returnflag as field, l_returnflag <> 'N' as structured, count(distinct l_linestatus) as k, count(distinct l_linenumber) as n from lineitem group by 1, 2, 3), v as (select persona_id, structured, (k - 1) * 1.0 / (n - 1) as v from f where n > 1)
  select persona_id, cast(round((1 - avg(v)) * 1e6) as bigint) as score_e6, coalesce(max(case when structured then v end), 0) = 0 and coalesce(max(case when not structured then v end), 0) <= 1 as passed from v group by 1""")
def reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("persona_id"), F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("field"), (F.col("l_returnflag") != "N").alias("structured"), F.col("l_linestatus").alias("value"))
    return dimensions.reproducibility(r).select("persona_id", e6(F.col("score")).alias("score_e6"), "passed")


@query("""with a as (select c_mktsegment as attribute, avg(case when c_acctbal > 4500 then 1.0 else 0.0 end) as rate from customer group by 1) select cast(round(avg(rate) * 1e6) as bigint) as score_e6, count(case when rate < 0.5 then 1 end) as sparse, avg(rate) >= 0.6 as passed from a where rate > 0""")
def sparse_dense_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dimensions.sparse_dense(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("attribute"), (F.col("c_acctbal") > 4500).alias("covered")))
    return d.select(e6(F.col("score")).alias("score_e6"), "sparse", "passed")


@query("""select c_nationkey as persona_id, cast(round((least(1, 5000 / greatest(c_acctbal, 1)) + least(1, 3.0 / greatest(c_custkey % 7, 1))) / 2 * 1e6) as bigint) as score_e6, greatest(c_acctbal, 1) <= 5000 and greatest(c_custkey % 7, 1) <= 3 as passed, c_custkey from customer""")
def cost_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), F.greatest("c_acctbal", F.lit(1.0)).alias("cost_usd"), F.greatest(F.col("c_custkey") % 7, F.lit(1)).cast("double").alias("latency_seconds"), "c_nationkey")
    d = dimensions.cost_latency(r, 5000.0, 3.0).withColumnRenamed("persona_id", "c_custkey").join(r.select(F.col("persona_id").alias("c_custkey"), F.col("c_nationkey").alias("persona_id")), "c_custkey")
    return d.select("persona_id", e6(F.col("score")).alias("score_e6"), "passed", "c_custkey")


@query("""select count(*) as n, cast(round(avg(case when toxic = 1 - quality then 1.0 else 0.0 end) * 1e6) as bigint) as score_e6 from labels""")
def role_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").select(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("guess"))
    return dimensions.role_identifiability(x).select(F.lit(x.count()).cast("bigint").alias("n"), e6(F.col("score")).alias("score_e6"))


def _turn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("persona_id"), "turn", "role", scalars.embed(F.col("text")).alias("v"))


@query()
def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation as claims, its questions as source chunks."""
    t = _turn_vectors(spark, sf_dir)
    d = dimensions.grounded_claims(t.where("role = 'assistant'").select("persona_id", F.col("turn").alias("claim_id"), "v"), t.where("role = 'user'").select("persona_id", "v"), 0.2)
    return d.select("persona_id", "claims", e6(F.col("score")).alias("score_e6"), "passed")


@query()
def answer_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn and the next as an answer before and after pressure."""
    t = _turn_vectors(spark, sf_dir)
    n = t.select("persona_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("b"))
    d = dimensions.shift_rate(t.join(n, ["persona_id", "turn"]).select("persona_id", F.col("v").alias("a"), "b"), 0.35)
    return d.select("persona_id", e6(F.col("rate")).alias("rate_e6"), "passed")


@query("""with u as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), n as (select vec_id, sqrt(sum(cast(x as double) * x)) as norm from u group by 1), v as (select vec_id, i, x / norm as x from u join n using (vec_id) where norm > 0),
  p as (select sum(a.x * b.x) as s from v a join v b on a.i = b.i and a.vec_id < b.vec_id group by a.vec_id, b.vec_id) select cast((select count(*) from embeddings) as bigint) as n, count(case when 1 - s < 0.05 then 1 end) as near_duplicates,
  cast(round((1 - avg(s)) * 1e5) as bigint) as distance_e5, count(case when 1 - s < 0.05 then 1 end) = 0 and 1 - avg(s) >= 0.1 as passed from p""")
def set_distinctiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("persona_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return dimensions.distinctiveness(e).select("n", "near_duplicates", F.round(F.col("distance") * 1e5).cast("bigint").alias("distance_e5"), "passed")


@query()
def suite_behavioral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regex and vector scorers over conversations, with personas without input reported as skipped."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("persona_id"), "role", F.col("text").alias("response"), "text", "turn")
    people, said = c.select("persona_id").distinct(), c.where("role = 'assistant'")
    t = _turn_vectors(spark, sf_dir)
    parts = {
        "D9": dimensions.knowledge_boundary(said),
        "D25": dimensions.emotional_regulation(said),
        "D30": dimensions.adversarial_robustness(said),
        "D27": dimensions.moral_stability(t.withColumn("foundation", F.col("role"))),
        "D31": dimensions.recovery(t.withColumn("phase", F.when(F.col("turn") < 2, "baseline").when(F.col("turn") > 3, "recovery"))),
    }
    out = None
    for k, d in parts.items():
        rows = dimensions.with_skips(d, people, k)
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("dimension_id").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("skipped").alias("skipped"))


# Scorers of figures and vectors that other queries don't reach.


@query("""with x as (select o_custkey as persona_id, case when o_orderkey % 3 > 0 then 1.0 else 0.0 end as hit, (o_orderkey % 10) / 10.0 as h from orders), g as (select persona_id, avg(hit) - avg(h) as gap from x group by 1)
  select persona_id, cast(round(greatest(0, 1 - 4 * greatest(0, gap - 0.25)) * 1e6) as bigint) as score_e6, gap <= 0.25 as passed from g""")
def hyper_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = placed(table(spark, sf_dir, "orders")).select(F.col("o_custkey").alias("persona_id"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("answer"), F.when(k % 3 > 0, F.col("o_orderpriority")).otherwise("x").alias("correct"), (k % 10 / 10).alias("human_accuracy"), "place")
    return dimensions.hyper_accuracy(a, ("place",)).select("persona_id", e6(F.col("score")).alias("score_e6"), "passed")


@query("""with x as (select doc_id % 20 as persona_id, toxic = 1 as adv, case when quality = 0 then 1.0 else 0.0 end as f from labels), g as (select persona_id, coalesce(avg(case when adv then f end), 0) as d, coalesce(avg(case when not adv then f end), 0) as a from x group by 1)
  select persona_id, cast(round(greatest(0, d - 0.3 * a) * 1e6) as bigint) as score_e6, greatest(0, d - 0.3 * a) >= 0.7 as passed from g""")
def judge_gaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("persona_id"), (F.col("toxic") == 1).alias("adversarial"), (F.col("quality") == 0).alias("flagged"))
    return dimensions.judge_gaming(x).select("persona_id", e6(F.col("score")).alias("score_e6"), "passed")


@query("""with r as (select user_id as persona_id, event_type, max(value / 500) - min(value / 500) as r from events group by 1, 2 having count(distinct event_id % 3) > 1) select persona_id, cast(round((1 - avg(r)) * 1e5) as bigint) as score_e5, max(r) <= 0.15 as passed from r group by 1""")
def cross_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("persona_id"), (F.col("event_id") % 3).alias("model"), F.col("event_type").alias("dimension"), (F.col("value") / 500).alias("value"))
    return dimensions.cross_model(x).select("persona_id", F.round(F.col("score") * 1e5).cast("bigint").alias("score_e5"), "passed")


@query("""with r as (select l_suppkey as persona_id, coalesce(corr(l_quantity, l_extendedprice), 0) as r, stddev_pop(l_quantity) as s from lineitem group by 1)
  select persona_id, cast(round(r * 1e6) as bigint) as score_e6, case when r >= 0.8 then 'high' when r >= 0.6 then 'moderate' when r >= 0.4 then 'low' else 'none' end as trust, r >= 0.6 and s >= 14 as passed from r""")
def judge_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("persona_id"), F.col("l_quantity").alias("judge"), F.col("l_extendedprice").alias("human"))
    return dimensions.judge_reliability(x, least_spread=14.0).select("persona_id", e6(F.col("score")).alias("score_e6"), "trust", "passed")


@query("""with x as (select least(1.0, d.n_chars / 4000.0) as conf, l.quality from labels l join documents d on d.doc_id = l.doc_id), b as (select greatest(ceil(conf * 10), 1) as bin, count(*) as n, avg(conf) as c, avg(quality) as a from x group by 1) select cast(sum(n) as bigint) as n, cast(round(sum(abs(c - a) * n) / sum(n) * 1e6) as bigint) as ece_e6 from b""")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agreement.ece(agreement.calibration_bins(scoring_plans._rated(spark, sf_dir), "conf", "quality"))
    return d.select("n", e6(F.col("ece")).alias("ece_e6"))


@query("""with l as (select c_mktsegment as persona_id, c_nationkey as level, avg(c_acctbal) / 1e4 as v from customer group by 1, 2), r as (select *, v > lag(v) over (partition by persona_id order by level) as rise from l), g as (select persona_id, greatest(0, arg_min(v, level) - arg_max(v, level)) as fall, avg(v) as mean, coalesce(bool_or(rise), false) as rose from r group by 1 having count(*) > 1)
  select persona_id, cast(round(fall * 1e5) as bigint) as drop_e5, cast(round(greatest(0, least(1, mean - 0.5 * greatest(0, fall - 0.5))) * 1e5) as bigint) as score_e5, fall <= 0.5 and not rose as passed from g""")
def generation_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("persona_id"), F.col("c_nationkey").alias("level")).agg((F.avg("c_acctbal") / 1e4).alias("v"))
    e5 = lambda c: F.round(F.col(c) * 1e5).cast("bigint").alias(f"{c}_e5")
    return dimensions.generation_bias(levels, "level", "v").select("persona_id", e5("drop"), e5("score"), "passed")


_PAIRS = """u as (select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), n as (select vec_id, sqrt(sum(cast(x as double) * x)) as norm from u group by 1),
  c as (select a.label, a.vec_id, sum(cast(a.x as double) * b.x) / (max(na.norm) * max(nb.norm) + 1e-10) as s from u a join u b on b.vec_id = a.vec_id + 1 and b.i = a.i join n na on na.vec_id = a.vec_id join n nb on nb.vec_id = b.vec_id group by 1, 2)"""


@query(f"with {_PAIRS} select label as persona_id, count(*) as n, cast(round(avg(s) * 1e5) as bigint) as score_e5, cast(round(min(s) * 1e5) as bigint) as least_e5, avg(s) >= 0.5 as passed from c group by 1 having count(*) >= 2")
def paraphrase_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    d = dimensions.pair_similarity(e.join(n, "vec_id").select(F.col("label").alias("persona_id"), "a", "b"))
    e5 = lambda c: F.round(F.col(c) * 1e5).cast("bigint").alias(f"{c}_e5")
    return d.select("persona_id", "n", e5("score"), e5("least"), "passed")


@query("""with u as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings), n as (select vec_id, sqrt(sum(cast(x as double) * x)) as norm from u group by 1),
  s as (select q.vec_id, r.vec_id as other, sum(cast(q.x as double) * r.x) / (max(nq.norm) * max(nr.norm) + 1e-10) as s from u q join u r on r.i = q.i and q.vec_id % 50 = 0 and r.vec_id % 50 > 0 join n nq on nq.vec_id = q.vec_id join n nr on nr.vec_id = r.vec_id group by 1, 2),
  b as (select vec_id, max(s) as best, 1.0 + vec_id % 3 as novelty, 0.2 + (vec_id % 4) / 10.0 as t from s group by 1) select cast(round(avg(case when best >= t then 1.0 else 0.0 end) * 1e6) as bigint) as score_e6, cast(round(sum(case when best >= t then novelty else 0 end) / sum(novelty) * 1e6) as bigint) as weighted_e6, avg(case when best >= t then 1.0 else 0.0 end) >= 0.1 as passed from b""")
def tail_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as an insight, the others as responses."""
    e, k = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), F.col("vec_id")
    insights = e.where(k % 50 == 0).select(k.alias("insight_id"), (1.0 + k % 3).alias("novelty"), (0.2 + k % 4 / 10).alias("threshold"), "v")
    return dimensions.tail_insights(insights, e.where(k % 50 > 0).select("v")).select(e6(F.col("score")).alias("score_e6"), e6(F.col("weighted")).alias("weighted_e6"), "passed")
