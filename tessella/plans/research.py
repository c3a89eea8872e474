"""Queries of the research metrics and the benchmark harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import research
from ..sources.records import table
from . import query
from .scoring import e6


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))


@query("""with r as (select distinct conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from conversations), p as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark),
  nr as (select conv_id, count(*) as nr from r group by 1), np as (select item_id, count(*) as np from p group by 1), s as (select conv_id, item_id, count(*) as s from r join p using (token) group by 1, 2),
  j as (select s.conv_id, s.item_id, s.s * 1.0 / (nr + np - s.s) as sim from s join nr on nr.conv_id = s.conv_id join np on np.item_id = s.item_id), b as (select *, row_number() over (partition by conv_id order by sim desc, item_id) as k from j)
  select nr.conv_id, item_id, cast(round(coalesce(sim, 0) * 1e6) as bigint) as sim_e6, coalesce(sim, 0) >= 0.05 as covered from nr left join (select * from b where k = 1) b on b.conv_id = nr.conv_id""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = _tokens(table(spark, sf_dir, "conversations"), "conv_id").distinct(), _tokens(table(spark, sf_dir, "benchmark"), "item_id").distinct()
    return research.best_coverage(r, p, "conv_id", "item_id").select("conv_id", "item_id", e6(F.col("sim")).alias("sim_e6"), "covered")


@query("""with t as (select lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), c as (select lang, token, count(*) as n from t group by 1, 2), p as (select lang, token, n * 1.0 / sum(n) over (partition by lang) as p from c),
  l as (select distinct lang from c), pairs as (select a.lang as a, b.lang as b from l a join l b on a.lang < b.lang), x as (select a, b, token, p from pairs join p on p.lang = a), y as (select a, b, token, p as q from pairs join p on p.lang = b),
  j as (select coalesce(x.a, y.a) as a, coalesce(x.b, y.b) as b, coalesce(p, 0) as p, coalesce(q, 0) as q from x full join y on x.a = y.a and x.b = y.b and x.token = y.token)
  select a, b, cast(round(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2 * 1e5) as bigint) as jsd_e5 from j group by a, b""")
def vocabulary_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = research.vocabulary_divergence(_tokens(table(spark, sf_dir, "documents"), "lang"), "lang")
    return d.select("a", "b", F.round(F.col("jsd") * 1e5).cast("bigint").alias("jsd_e5"))


@query("""with f as (select 'segment' as axis, c_mktsegment as v from customer union all select 'nation', cast(c_nationkey as varchar) from customer), c as (select axis, v, count(*) as n from f group by 1, 2), p as (select axis, n * 1.0 / sum(n) over (partition by axis) as p from c),
  a as (select axis, count(*) as k, max(p) as m, sum(p * p) as sq from p group by axis) select axis, k, cast(round(m * 1e6) as bigint) as mode_e6, cast(round(case when k < 2 then 1 else (sq - 1.0 / k) / (1 - 1.0 / k) end * 1e6) as bigint) as gini_e6,
  case when m > 0.6 then 'collapsed' when m < 0.4 then 'diverse' else 'mixed' end as verdict from a""")
def axis_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    d = research.axis_diversity(c.unpivot([], ["segment", "nation"], "axis", "v"), "axis", "v")
    return d.select("axis", "k", e6(F.col("mode_share")).alias("mode_e6"), e6(F.col("gini")).alias("gini_e6"), "verdict")


@query("""with t as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from benchmark), c as (select item_id, token, count(*) as c from t group by 1, 2), n as (select count(distinct item_id) as n from t), d as (select token, count(*) as df from c group by 1), s as (select item_id, count(*) as total from t group by 1)
  select c.item_id, c.token, cast(round(c * 1.0 / total * (ln((n + 1.0) / (df + 1)) + 1) * 1e6) as bigint) as w_e6 from c join d on d.token = c.token join s on s.item_id = c.item_id, n""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    t = _tokens(b, "item_id")
    return research.tfidf(t, "item_id", "token", t.select("item_id").distinct().count()).select("item_id", "token", e6(F.col("w")).alias("w_e6"))


@query("""with x as (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id) as k, count(*) over (partition by user_id) as n, (epoch(timestamp '2024-01-31 00:00:00') - floor(epoch(ts))) / 86400.0 as age from events)
  select event_id, cast(round(exp(-age / 7) * 1e6) as bigint) as weight_e6, case when k <= ceil(n * 0.3) then 'high' when k > floor(n * 0.7) then 'low' else 'medium' end as band from x""")
def recency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    d = research.recency(table(spark, sf_dir, "events"), ["user_id"], "ts", now, 7.0, ["event_id"])
    return d.select("event_id", e6(F.col("weight")).alias("weight_e6"), "band")


@query("""with x as (select conv_id, turn, cast(length(text) as double) as v from conversations), b as (select conv_id, arg_min(v, turn) as baseline, arg_max(v, turn) as final, min(turn) as t0, max(turn) as t1 from x group by conv_id),
  h as (select x.conv_id, min(turn) as half_life from x join b on b.conv_id = x.conv_id where v < baseline / 2 group by 1) select b.conv_id, cast(baseline as bigint) as baseline, cast(final as bigint) as final, half_life, cast(round(case when t1 > t0 then (baseline - final) / (t1 - t0) else 0 end * 1e4) as bigint) as decay_e4 from b left join h on h.conv_id = b.conv_id""")
def drift_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("v"))
    d = research.half_life(c, ["conv_id"], "turn", "v")
    return d.select("conv_id", F.col("baseline").cast("bigint").alias("baseline"), F.col("final").cast("bigint").alias("final"), "half_life", F.round(F.col("decay") * 1e4).cast("bigint").alias("decay_e4"))


@query("""with a as (select event_type, count(*) * 1.0 as v from events where user_id % 2 = 0 group by 1), b as (select event_type, count(*) * 1.0 as v from events where user_id % 3 = 0 group by 1)
  select coalesce(a.event_type, b.event_type) as event_type, cast(coalesce(b.v, 0) - coalesce(a.v, 0) as bigint) as delta from a full join b on a.event_type = b.event_type""")
def ab_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    arm = lambda k: e.where(F.col("user_id") % k == 0).groupBy("event_type").agg(F.count("*").cast("double").alias("v"))
    return research.ab_deltas(arm(2), arm(3), "event_type", "v").select("event_type", F.col("delta").cast("bigint").alias("delta"))


@query("""select event_type, user_id % 4 as arm, count(*) as n, count(case when value > 250 then 1 end) as hits, cast(grouping(event_type) as bigint) as g1, cast(grouping(user_id % 4) as bigint) as g2 from events group by grouping sets ((event_type, user_id % 4), (event_type), ())""")
def grouping_set_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("arm"), "value")
    d = e.groupingSets([["event_type", "arm"], ["event_type"], []], "event_type", "arm")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 250).alias("hits"), F.grouping("event_type").cast("bigint").alias("g1"), F.grouping("arm").cast("bigint").alias("g2"))


@query("""with d as (select user_id, min(case when event_type = 'error' and value > 250 then event_id end) as hit from events group by user_id) select user_id, hit, hit is null as missed from d""")
def time_to_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.min(F.when((F.col("event_type") == "error") & (F.col("value") > 250), F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(hit.alias("hit")).withColumn("missed", F.col("hit").isNull())


_RUNS = """c as (select o_orderstatus as variant, year(o_orderdate) as suite, o_orderpriority = '1-URGENT' as failed, o_totalprice / 1e5 as g, o_orderkey % 4 as att, o_totalprice / 1e3 as cost, case when o_orderkey % 3 > 0 then o_totalprice / 2e5 end as j from orders where o_orderdate < date '1998-01-01'),
  r as (select variant, suite, count(*) as n, count(case when not failed then 1 end) as ok, count(case when not failed then 1 end) * 1.0 / count(*) as s, coalesce(avg(case when not failed then g end), 0) as g, coalesce(avg(case when not failed then att end), 0) as att, sum(cost) as cost, avg(case when not failed then j end) as j from c group by 1, 2)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters of benchmark runs, by status and year."""
    o, price, k = table(spark, sf_dir, "orders").where("o_orderdate < date '1998-01-01'"), F.col("o_totalprice"), F.col("o_orderkey")
    rows = o.select(
        F.col("o_orderstatus").alias("variant"), F.year("o_orderdate").cast("bigint").alias("suite"), (F.col("o_orderpriority") == "1-URGENT").alias("failed"), (price / 1e5).alias("groundedness"),
        (k % 4).alias("attempts"), (price / 1e3).alias("cost_usd"), F.when(k % 3 > 0, price / 2e5).alias("judge"),
    )
    return research.run_totals(rows, ["variant", "suite"])


@query(f"with {_RUNS} select variant, suite, n as n_personas, ok as n_ok, cast(round(s * 1e6) as bigint) as success_e6, cast(round(g * 1e5) as bigint) as groundedness_e5, cast(round(att * 1e5) as bigint) as attempts_e5, cast(round(cost) as bigint) as cost, cast(round(j * 1e5) as bigint) as judge_e5 from r")
def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e5 = lambda c: F.round(F.col(c) * 1e5).cast("bigint").alias(f"{c}_e5")
    return _runs(spark, sf_dir).select("variant", "suite", "n_personas", "n_ok", e6(F.col("success_rate")).alias("success_e6"), e5("groundedness"), e5("attempts"), F.round("cost").cast("bigint").alias("cost"), e5("judge"))


@query(f"""with {_RUNS}, d as (select b.suite, b.variant, b.j - a.j as dj, b.g - a.g as dg, b.s - a.s as ds, coalesce((b.cost - a.cost) * 100 / nullif(a.cost, 0), 0) as dc, b.ok from r a join r b on a.suite = b.suite where a.variant = 'O' and b.variant <> 'O'), x as (select *, coalesce(dj, 0) as z from d)
  select suite, variant, cast(round(dg * 1e5) as bigint) as dg_e5, cast(round(ds * 1e5) as bigint) as ds_e5, cast(round(dc) as bigint) as cost_pct,
  case when z < -0.1 or dg < -0.05 or dc > 50 or ds < -0.05 then 'REJECT' when z >= 0.1 or (dg >= 0.05 and ds >= 0) then case when dc < 20 then 'MERGE' else 'MERGE-WITH-CAVEAT' end when abs(z) <= 0.02 and abs(dg) <= 0.02 and abs(dc) <= 5 and abs(ds) <= 0.02 then 'NEUTRAL' else 'REVIEW' end as verdict,
  case when ok = 0 then 'REJECT-BROKEN' when z < -0.15 or dg < -0.05 or ds < -0.10 or dc > 80 then 'REJECT' when ds < -0.05 then 'REJECT-RELIABILITY' when z >= 0.15 and dc < 30 then 'MERGE' when dg >= 0.05 and ds >= 0 and dc < 30 then 'MERGE' when z >= 0.05 and ds >= 0 and dc < 15 then 'MERGE'
    when abs(z) <= 0.05 and abs(dg) <= 0.02 and abs(dc) <= 10 and abs(ds) <= 0.05 then 'NEUTRAL' else 'REVIEW' end as decision from x""")
def benchmark_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    d = research.run_deltas(r.where("variant = 'O'"), r.where("variant <> 'O'"), ["suite"], keep=("variant",))
    dj, dg, cost, ds = (F.col(c) for c in ("d_judge", "d_groundedness", "cost_pct", "d_success"))
    return d.select(
        "suite", "variant", F.round(dg * 1e5).cast("bigint").alias("dg_e5"), F.round(ds * 1e5).cast("bigint").alias("ds_e5"), F.round(cost).cast("bigint").alias("cost_pct"),
        research.verdict(dj, dg, cost, ds).alias("verdict"), research.decision(dj, dg, cost, ds, F.col("n_ok")).alias("decision"),
    )


CLAIMS = """claims as (select o_custkey as persona, cast(o_orderkey as varchar) as path, o_orderkey as k from orders), ev as (select o_custkey as persona, cast(o_orderkey as varchar) as path, l_linenumber, l_orderkey * 10 + l_linenumber as record_id, l_returnflag from lineitem join orders on l_orderkey = o_orderkey)"""


@query(f"""with {CLAIMS}, g as (select distinct persona, path from ev where l_returnflag <> 'R'), s as (select c.persona, count(*) as claims, count(g.path) as grounded from claims c left join g on g.persona = c.persona and g.path = c.path group by 1)
  select persona, claims, grounded, grounded >= 0.9 * claims as passed from s""")
def groundedness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims, their lines as evidence, lines that weren't returned as valid records."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("persona"), F.col("o_orderkey").cast("string").alias("path"), "o_orderkey")
    e = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select("persona", "path", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), "l_returnflag")
    valid = e.where("l_returnflag <> 'R'").select("persona", "record_id").distinct()
    # an order has evidence if a line of it has; lines with an id that isn't valid are the operator's to find
    ev = e.select("persona", "path", F.array("record_id").alias("record_ids"))
    d = research.groundedness(o.select("persona", "path"), ev, valid)
    return d.select("persona", "claims", "grounded", (F.col("grounded") >= 0.9 * F.col("claims")).alias("passed"))


@query(f"""with {CLAIMS}, have as (select persona, path, l_linenumber as n from ev where l_returnflag = 'A'), miss as (select c.persona, c.path from claims c where not exists (select 1 from have h where h.persona = c.persona and h.path = c.path))
  select persona, count(*) as entries, cast(sum(filled) as bigint) as backfilled from (select persona, 0 as filled from have union all select persona, 1 from miss) group by persona""")
def evidence_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("persona"), F.col("o_orderkey").cast("string").alias("path"), "o_orderkey")
    e = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    e = e.select("persona", "path", F.array((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("record_ids"), F.lit(0.9).alias("confidence"))
    first = o.groupBy("persona").agg(F.min(F.col("o_orderkey").cast("string")).alias("record_id"))
    d = research.evidence_backfill(o.select("persona", "path"), e, first)
    return d.groupBy("persona").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("confidence") == 0.55, 1).otherwise(0)).alias("backfilled"))
