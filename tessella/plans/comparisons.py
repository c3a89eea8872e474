"""Queries that compare: clusterings, judges' verdicts, distributions, evidence that was swapped, personas
with fields taken away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import ablation, agreement_sets, evidence, layout, research, tournament
from ..sources.records import table
from . import query
from .research import e6


@query("""with l as (select doc_id % 3 as part, lang as a, source as b from documents where lang is not null and source is not null),
  c as (select part, a, b, count(*) as n from l group by 1, 2, 3), s as (select part, sum(n) as n, sum(n * (n - 1) / 2.0) as s from c group by 1),
  x as (select part, sum(n * (n - 1) / 2.0) as sa from (select part, a, sum(n) as n from c group by 1, 2) group by 1), y as (select part, sum(n * (n - 1) / 2.0) as sb from (select part, b, sum(n) as n from c group by 1, 2) group by 1),
  z as (select part, s.n, s, (sa + sb) / 2 as most, sa * sb / (s.n * (s.n - 1) / 2.0) as chance from s join x using (part) join y using (part))
  select part, cast(n as bigint) as n, cast(round(case when most = chance then 1 else (s - chance) / (most - chance) end * 1e6) as bigint) as ari_e6 from z""")
def clustering_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and sources as two clusterings of documents."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("part"), "lang", "source")
    return agreement_sets.adjusted_rand(d, "lang", "source", ["part"]).select("part", "n", e6(F.col("ari")).alias("ari_e6"))


#: Orders as verdicts on eight personas: a and b, who won with a first, and who won, by place, with b first.
VERDICTS = """v as (select o_orderkey, o_orderkey % 2 as judge, o_orderpriority as dimension, o_custkey % 8 as a, (o_orderkey % 7 + 1 + o_custkey) % 8 as b from orders),
  w as (select *, case when o_orderkey * 7919 % 100 >= 95 then 'tie' when o_orderkey * 7919 % 100 < 50 + 5 * (b - a) then 'a' else 'b' end as first,
  case when o_orderkey * 3001 % 100 >= 95 then 'tie' when o_orderkey * 3001 % 100 < 45 + 5 * (b - a) then 'b' else 'a' end as second from v),
  t as (select *, case second when 'a' then 'b' when 'b' then 'a' else 'tie' end as turned from w), d as (select *, case when first = turned then first else 'tie' end as winner, first <> turned and first <> 'tie' and turned <> 'tie' as flipped from t)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf_dir, "orders").select(k, (k % 2).alias("judge"), F.col("o_orderpriority").alias("dimension"), (c % 8).alias("a"), ((k % 7 + 1 + c) % 8).alias("b"))
    x, y, ahead = k * 7919 % 100, k * 3001 % 100, 5 * (F.col("b") - F.col("a"))
    first = F.when(x >= 95, "tie").when(x < 50 + ahead, "a").otherwise("b")
    second = F.when(y >= 95, "tie").when(y < 45 + ahead, "b").otherwise("a")
    return d.select("judge", "dimension", "a", "b", first.alias("first"), second.alias("second"))


@query(f"""with {VERDICTS}, s as (select judge, a as persona, winner = 'a' as w, winner = 'b' as l from d union all select judge, b, winner = 'b', winner = 'a' from d)
  select judge, persona, count(case when w then 1 end) as wins, count(case when not w and not l then 1 end) as ties, count(case when l then 1 end) as losses, cast(2 * count(case when w then 1 end) + count(case when not w and not l then 1 end) as bigint) as halves from s group by 1, 2""")
def tournament_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tournament.win_counts(verdicts(spark, sf_dir), ["judge"])
    return d.select("judge", "persona", "wins", "ties", "losses", (F.col("score") * 2).cast("bigint").alias("halves"))


@query(f"with {VERDICTS} select judge, dimension, count(*) as votes, count(case when flipped then 1 end) as flips, cast(round(count(case when flipped then 1 end) * 1.0 / count(*) * 1e6) as bigint) as rate_e6 from d group by 1, 2")
def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.position_bias(verdicts(spark, sf_dir), ["judge", "dimension"]).withColumn("rate_e6", e6(F.col("rate"))).drop("rate")


@query()
def tournament_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.strengths(verdicts(spark, sf_dir), ["judge"])


@query("""with o as (select o_orderpriority as part, o_totalprice as v, o_orderstatus as s from orders where o_orderstatus in ('F', 'O')), c as (select part, v, count(case when s = 'F' then 1 end) as a, count(case when s = 'O' then 1 end) as b from o group by 1, 2),
  r as (select part, sum(a) over w as ca, sum(b) over w as cb, sum(a) over (partition by part) as na, sum(b) over (partition by part) as nb from c window w as (partition by part order by v))
  select part, cast(max(na) as bigint) as n_a, cast(max(nb) as bigint) as n_b, cast(round(max(abs(ca * 1.0 / na - cb * 1.0 / nb)) * 1e9) as bigint) as ks_e9 from r group by part""")
def ks_of_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of orders that are done against those of open ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    d = stats.ks_two(o, "v", "s", ("F", "O"), ["part"])
    return d.select("part", "n_a", "n_b", F.round(F.col("ks") * 1e9).cast("bigint").alias("ks_e9"))


@query()
def ks_against_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each priority against a normal distribution of the mean and spread of all."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_totalprice").cast("double").alias("v"))
    same = o.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))  # one row
    reference = o.select("part").distinct().join(same, F.lit(True))
    return stats.ks_normal(o, "v", reference, "part")


#: Orders as claims of customers, which are personas in clusters by nation; open orders are no records.
EVIDENCE = """e as (select c_nationkey as cluster, o_custkey as persona, (case o_orderkey % 3 when 0 then 'goals.' when 1 then 'pains.' else 'summary.' end) || cast(o_orderkey as varchar) as path, o_orderkey as k, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as p, o_orderstatus as s from orders join customer on c_custkey = o_custkey),
  ev as (select *, case when p is null then [k] else [k, p] end as ids from e), rec as (select distinct cluster, k as record_id from e where s <> 'P')"""
TRIALS = 3


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    field = F.when(k % 3 == 0, "goals.").when(k % 3 == 1, "pains.").otherwise("summary.")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))  # of one customer
    e = o.select(F.col("c_nationkey").alias("cluster"), F.col("o_custkey").alias("persona"), F.concat(field, k.cast("string")).alias("path"), F.array_compact(F.array(k, before)).alias("record_ids"), k.alias("record_id"), "o_orderstatus")
    return e.select("cluster", "persona", "path", "record_ids"), e.where("o_orderstatus <> 'P'").select("cluster", "record_id")


_SWAP = f"""{EVIDENCE}, ring as (select cluster, record_id, row_number() over (partition by cluster order by md5('42:' || cast(record_id as varchar)), record_id) - 1 as pos, count(*) over (partition by cluster) as m from rec),
  t as (select ev.*, trial, m, ('0x' || substr(md5('42:' || cast(trial as varchar) || ':' || cast(persona as varchar) || ':' || path), 1, 8))::bigint % m as place from ev join (select cluster, max(m) as m from ring group by 1) using (cluster), (select unnest(range({TRIALS})) as trial) where s is not null and path not like 'summary.%'),
  q as (select t.trial, t.persona, t.path, len(ids) as n, r.record_id, (r.pos - t.place + t.m) % t.m as step from t join ring r on r.cluster = t.cluster and (r.pos - t.place + t.m) % t.m < 2 * len(ids) where not list_contains(ids, r.record_id)),
  n as (select *, row_number() over (partition by trial, persona, path order by step) as j from q), new as (select trial, persona, path, string_agg(cast(record_id as varchar), ',' order by j) as ids from n where j <= n group by 1, 2, 3),
  sw as (select trial, ev.persona, ev.cluster, ev.path, coalesce(new.ids, array_to_string(ev.ids, ',')) as record_ids, new.ids is not null as swapped from ev cross join (select unnest(range({TRIALS})) as trial) left join new using (trial, persona, path))"""


@query(f"with {_SWAP} select cast(trial as integer) as trial, persona, path, record_ids, swapped from sw")
def evidence_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evidence.swap_within(*_evidence(spark, sf_dir), trials=TRIALS)
    return d.withColumn("record_ids", F.array_join(F.col("record_ids").cast("array<string>"), ","))


@query(f"""with {_SWAP}, good as (select trial, persona, path, swapped, not exists (select 1 from (select unnest(string_split(record_ids, ',')) as r) x where cast(r as bigint) not in (select record_id from rec where rec.cluster = sw.cluster)) as ok from sw),
  g as (select trial, persona, count(*) as claims, count(case when ok then 1 end) as grounded, count(case when swapped then 1 end) as swapped from good group by 1, 2)
  select persona, count(*) as trials, cast(sum(swapped) as bigint) as swapped, count(case when grounded * 1.0 / claims >= 0.9 then 1 end) as passes, cast(round(count(case when grounded * 1.0 / claims >= 0.9 then 1 end) * 1.0 / count(*) * 1e6) as bigint) as rate_e6 from g group by 1""")
def evidence_false_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = _evidence(spark, sf_dir)
    d = evidence.false_passes(e.select("persona", "path"), e, r, trials=TRIALS)
    return d.withColumn("rate_e6", e6(F.col("false_pass_rate"))).drop("false_pass_rate")


@query(f"""with {EVIDENCE}, ranked as (select cluster, record_id, row_number() over (partition by cluster order by record_id) - 1 as pos, count(*) over (partition by cluster) as m from rec),
  f as (select cluster, lead(cluster) over (order by cluster) as other from (select distinct cluster from rec)),
  x as (select ev.persona, ev.path, step, r.record_id from ev join f using (cluster), (select unnest(range(2)) as step) s, ranked r where step < len(ids) and r.cluster = f.other and r.pos = step % r.m)
  select persona, path, string_agg(cast(record_id as varchar), ',' order by step) as record_ids from x group by 1, 2""")
def evidence_from_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's evidence from the next nation's records."""
    from pyspark.sql import Window

    e, r = _evidence(spark, sf_dir)
    f = r.select("cluster").distinct().withColumn("other", F.lead("cluster").over(Window.partitionBy(F.lit(0)).orderBy("cluster"))).where("other is not null")  # a row a nation
    return evidence.swap_across(e, r, f).withColumn("record_ids", F.array_join(F.col("record_ids").cast("array<string>"), ","))


def field_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as personas with so many entries in each field, some of them blank."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    entries = lambda i: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.when(j % 4 == 0, " ").otherwise(F.concat(F.lit("e"), j.cast("string"))))
    size = lambda i: ((k * (2 * i + 3) + F.floor(k / (i + 2))) % 8).cast("int")
    return c.select(k.alias("persona_id"), *(F.when(k % 11 != i, F.slice(entries(i), F.lit(1), size(i))).alias(f) for i, f in enumerate(ablation.FIELDS)))


@query()
def spine_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.spine(field_personas(spark, sf_dir))


@query()
def removal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation.removal_ranking(ablation.spine(field_personas(spark, sf_dir)))


# Vectors of texts: cosine pairs and a layout.

NEAR = 0.15


def _item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    t = b.select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("token"))
    n = t.select("item_id").distinct().count()
    return layout.unit(research.tfidf(t, "item_id", "token", n), "item_id", "token")


@query(f"""with t as (select item_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as token from benchmark), c as (select item_id, token, count(*) as c from t group by 1, 2), n as (select count(distinct item_id) as n from t), d as (select token, count(*) as df from c group by 1), s as (select item_id, count(*) as total from t group by 1),
  w as (select c.item_id, c.token, c * 1.0 / total * (ln((n + 1.0) / (df + 1)) + 1) as w from c join d using (token) join s using (item_id), n), l as (select item_id, sqrt(sum(w * w)) as l from w group by 1), u as (select item_id, token, w / l as w from w join l using (item_id)),
  p as (select x.item_id as a, y.item_id as b, sum(x.w * y.w) as cosine from u x join u y on x.token = y.token and x.item_id < y.item_id group by 1, 2) select a, b, cast(round(cosine * 1e6) as bigint) as cosine_e6 from p where cosine >= {NEAR}""")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cosine_pairs(_item_vectors(spark, sf_dir), "item_id", "token", NEAR).select("a", "b", e6(F.col("cosine")).alias("cosine_e6"))


@query()
def tfidf_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout(_item_vectors(spark, sf_dir), "item_id", "token")
