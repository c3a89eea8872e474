"""Queries of cluster summaries. Clusters are those of a fixed rule, users by their number modulo 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment, summaries
from ..sources.records import event_records, table
from . import query
from .ingest import RECORDS

MEMBERS = "m as (select distinct tenant_id, cast(user_id as integer) % 3 as cluster, user_id from records), rc as (select r.*, m.cluster from records r join m on r.tenant_id = m.tenant_id and r.user_id = m.user_id)"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event records, with the fields that business and support records have."""
    r, seq = event_records(table(spark, sf_dir, "events")), F.col("seq")
    more = {
        "contact_title": F.when(seq % 2 == 0, F.concat(F.lit("title "), seq % 5)),
        "company_size": (seq % 3).cast("string"),
        "industry": F.concat(F.lit("industry "), seq % 4),
        "topic": F.concat(F.lit("topic "), seq % 6),
        "message": F.when(seq % 3 > 0, F.repeat(F.concat(F.lit("word "), F.col("payload")["k"], F.lit(" ")), 30)),
    }
    entries = F.create_map(*(x for k, v in more.items() for x in (F.lit(k), v)))
    return r.withColumn("payload", F.map_concat("payload", entries))


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = _records(spark, sf_dir)
    members = r.select("tenant_id", (F.col("user_id").cast("int") % 3).alias("cluster"), "user_id").distinct()
    return summaries.cluster_records(r, members), members


def _top_sql(name: str, rows: str) -> str:
    return f"""{name}_c as (select tenant_id, cluster, item, count(*) as n, min(f) as f from ({rows}) group by 1, 2, 3),
  {name}_r as (select *, row_number() over (partition by tenant_id, cluster order by n desc, f) as rank from {name}_c),
  {name} as (select tenant_id, cluster, string_agg(item, ',' order by rank) as {name} from {name}_r where rank <= 8 group by 1, 2)"""


@query(f"""with {RECORDS}, {MEMBERS}, {_top_sql("top_behaviors", "select tenant_id, cluster, event_type as item, seq * 2 as f from rc union all select tenant_id, cluster, tagged, seq * 2 + 1 from rc")},
  {_top_sql("top_pages", "select tenant_id, cluster, page as item, seq as f from rc")},
  s as (select tenant_id, cluster, string_agg(source || ':' || cast(n as varchar), ',' order by source) as sources, cast(sum(n) as bigint) as n_records from (select tenant_id, cluster, source, count(*) as n from rc group by 1, 2, 3) group by 1, 2),
  d as (select tenant_id, cluster, avg(v) as v from (select tenant_id, cluster, user_id, avg(value) as v from rc where source = 'ga4' group by 1, 2, 3) group by 1, 2),
  z as (select tenant_id, cluster, count(*) as cluster_size from m group by 1, 2)
  select z.tenant_id, z.cluster, cluster_size, n_records, top_behaviors, top_pages, sources, cast(round(d.v * 1e5) as bigint) as session_e5 from z
  join s using (tenant_id, cluster) join top_behaviors using (tenant_id, cluster) join top_pages using (tenant_id, cluster) left join d using (tenant_id, cluster)""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_cluster, members = _clustered(spark, sf_dir)
    s = summaries.summary(of_cluster, members)
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ",")
    return s.select(
        "tenant_id", "cluster", "cluster_size", "n_records", F.array_join("top_behaviors", ",").alias("top_behaviors"), F.array_join("top_pages", ",").alias("top_pages"),
        sources.alias("sources"), F.round(F.col("avg_session_duration") * 1e5).cast("bigint").alias("session_e5"),
    )


@query(f"""with {RECORDS}, {MEMBERS}, a as (select tenant_id, cluster, 'average' as kind, 'session_duration' as name, cast(null as varchar) as value, cast(round(avg(v) * 1e5) as bigint) as number_e5
    from (select tenant_id, cluster, user_id, avg(value) as v from rc where source = 'ga4' group by 1, 2, 3) group by 1, 2),
  e as (select tenant_id, cluster, user_id, event_type, count(*) as n, min(seq) as f from rc group by 1, 2, 3, 4), u as (select *, row_number() over (partition by tenant_id, user_id order by n desc, f) as k from e),
  v as (select tenant_id, cluster, event_type, count(*) as n, min(cast(user_id as bigint)) as f from u where k = 1 group by 1, 2, 3), w as (select *, row_number() over (partition by tenant_id, cluster order by n desc, f) as k from v)
  select * from a union all select tenant_id, cluster, 'mode', 'event', event_type, null from w where k = 1 union all select distinct tenant_id, cluster, 'member', 'sources', source, cast(null as bigint) from rc""")
def cluster_typed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_cluster, members = _clustered(spark, sf_dir)
    numeric = segment.numeric_means(segment.payload_features(of_cluster))
    events = segment.modes(of_cluster.withColumn("v", F.col("payload")["event"]), ["tenant_id", "user_id"], "v").select("tenant_id", "user_id", F.lit("event").alias("name"), "mode", F.col("user_id").cast("bigint").alias("seq"))
    sets = of_cluster.select("tenant_id", "user_id", F.lit("sources").alias("name"), F.col("source").alias("item"))
    t = summaries.typed_features(members, numeric, events, sets)
    return t.select("tenant_id", "cluster", "kind", "name", "value", F.round(F.col("number") * 1e5).cast("bigint").alias("number_e5"))


@query(f"""with {RECORDS}, {MEMBERS}, x as (select tenant_id, cluster, 'title' as kind, seq * 2 as f, 'title ' || cast(seq % 5 as varchar) as value from rc where source = 'hubspot' and seq % 2 = 0
    union all select tenant_id, cluster, 'company_size', seq * 2, cast(seq % 3 as varchar) from rc where source = 'hubspot' union all select tenant_id, cluster, 'industry', seq * 2, 'industry ' || cast(seq % 4 as varchar) from rc where source = 'hubspot'
    union all select tenant_id, cluster, 'tech_event', seq * 2, event_type from rc where source = 'ga4' union all select tenant_id, cluster, 'tech_event', seq * 2 + 1, tagged from rc where source = 'ga4'),
  c as (select tenant_id, cluster, kind, value, count(*) as n, min(f) as f from x group by 1, 2, 3, 4 union all select tenant_id, cluster, 'intent', 'topic ' || cast(seq % 6 as varchar) || case when seq % 3 > 0 then ': ' || substr(repeat('word ' || k || ' ', 30), 1, 100) || '...' else '' end, 1, seq * 2 from rc where source = 'intercom'),
  r as (select *, row_number() over (partition by tenant_id, cluster, kind order by case when kind = 'company_size' then -n else 0 end, f) as rank from c)
  select tenant_id, cluster, kind, value, n, rank from r where kind <> 'company_size' or rank = 1""")
def cluster_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = summaries.enrichment(_clustered(spark, sf_dir)[0])
    return e.select("tenant_id", "cluster", "kind", "value", "n", F.col("rank").cast("bigint").alias("rank"))


# The sample takes a record for each top behavior in turn; the twin says the turns one by one, as far
# as eight behaviors go, by ranks within what is left. Its records are never bots'.
@query(f"""with {RECORDS}, {MEMBERS}, {_top_sql("top_behaviors", "select tenant_id, cluster, event_type as item, seq * 2 as f from rc union all select tenant_id, cluster, tagged, seq * 2 + 1 from rc")},
  h as (select rc.tenant_id, rc.cluster, rc.seq, record_id, t.rank from rc join top_behaviors_r t on t.tenant_id = rc.tenant_id and t.cluster = rc.cluster and t.rank <= 8 and (t.item = event_type or t.item = tagged)),
  {", ".join(f"p{i} as (select tenant_id, cluster, min(seq) as seq from h where rank = {i}" + "".join(f" and not exists (select 1 from p{j} where p{j}.tenant_id = h.tenant_id and p{j}.cluster = h.cluster and p{j}.seq = h.seq)" for j in range(1, i)) + " group by 1, 2)" for i in range(1, 9))},
  p as ({" union all ".join(f"select *, {i} as turn from p{i}" for i in range(1, 9))}), q as (select *, row_number() over (partition by tenant_id, cluster order by turn) as rank from p),
  n as (select tenant_id, cluster, count(*) as n from q group by 1, 2),
  f as (select rc.tenant_id, rc.cluster, rc.seq, row_number() over (partition by rc.tenant_id, rc.cluster order by rc.seq) + n.n as rank from rc join n using (tenant_id, cluster) where not exists (select 1 from q where q.tenant_id = rc.tenant_id and q.cluster = rc.cluster and q.seq = rc.seq)),
  b as (select tenant_id, cluster, seq, rank from q union all select tenant_id, cluster, seq, rank from f where rank <= 12) select tenant_id, cluster, 'ev_' || cast(seq as varchar) as record_id, rank from b""")
def cluster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_cluster = _clustered(spark, sf_dir)[0]
    s = summaries.representative_sample(summaries.without_bots(of_cluster, "record_id", "seq", "behaviors"), summaries.top_values(of_cluster, "behaviors"))
    return s.select("tenant_id", "cluster", "record_id", F.col("rank").cast("bigint").alias("rank"))


_QUALITY = f"""{RECORDS}, {MEMBERS}, b as (select tenant_id, cluster, user_id, event_type as x from rc union select tenant_id, cluster, user_id, tagged from rc), u as (select tenant_id, cluster, user_id, count(*) as k from b group by 1, 2, 3),
  w as (select tenant_id, cluster, count(distinct x) as n from b group by 1, 2), r as (select tenant_id, user_id, count(*) as n_records from records group by 1, 2), s as (select u.tenant_id, u.cluster, u.user_id, k * 1.0 / n as sim, n_records from u join w on w.tenant_id = u.tenant_id and w.cluster = u.cluster join r on r.tenant_id = u.tenant_id and r.user_id = u.user_id)"""


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    of_cluster, members = _clustered(spark, sf_dir)
    return segment.user_sets(_records(spark, sf_dir)), members


@query(f"""with {_QUALITY}, c as (select tenant_id, cluster, count(*) as size, avg(sim) as compactness from s where cluster > 0 group by 1, 2), t as (select tenant_id, count(distinct user_id) as users from records group by 1)
  select t.tenant_id, users, count(*) as clusters, cast(users - sum(size) as bigint) as noise, cast(round(avg(compactness) * 1e6) as bigint) as compactness_e6, cast(round(greatest(0, 1 - stddev_pop(size) / avg(size)) * 1e6) as bigint) as balance_e6 from t join c on c.tenant_id = t.tenant_id group by 1, 2""")
def clustering_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of every third number belong to no cluster."""
    users, members = _users(spark, sf_dir)
    d = summaries.clustering_report(users, members.where("cluster > 0"))
    return d.select("tenant_id", "users", "clusters", "noise", F.round(F.col("compactness") * 1e6).cast("bigint").alias("compactness_e6"), F.round(F.col("balance") * 1e6).cast("bigint").alias("balance_e6"))


@query(f"with {_QUALITY}, o as (select *, row_number() over (partition by tenant_id, cluster order by sim, n_records, user_id) as k from s) select tenant_id, cluster, user_id, cast(round(sim * 1e6) as bigint) as similarity_e6 from o where k = 1")
def outlier_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.outliers(*_users(spark, sf_dir)).select("tenant_id", "cluster", "user_id", F.round(F.col("similarity") * 1e6).cast("bigint").alias("similarity_e6"))


@query(f"""with {RECORDS}, h as (select *, seq % 40 = 0 as base, seq % 40 = 0 or seq % 90 = 1 as more from records), b as (select event_type as x, base, more from h union all select tagged, base, more from h), n as (select count(distinct x) as k from b)
  select 'base' as sampled, cast(round(avg(case when base then 1e6 else 0 end)) as bigint) as records_e6, (select cast(round(count(distinct case when base then x end) * 1e6 / max(k)) as bigint) from b, n) as behaviors_e6 from h
  union all select 'with more', cast(round(avg(case when more then 1e6 else 0 end)) as bigint), (select cast(round(count(distinct case when more then x end) * 1e6 / max(k)) as bigint) from b, n) from h""")
def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    d = summaries.sample_coverage(r, r.where("seq % 40 = 0"), r.where("seq % 90 = 1"))
    return d.select("sampled", F.round(F.col("records") * 1e6).cast("bigint").alias("records_e6"), F.round(F.col("behaviors") * 1e6).cast("bigint").alias("behaviors_e6"))


@query()
def verbatim_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.verbatim_samples(_clustered(spark, sf_dir)[0])


@query()
def segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users clustered by what they do, and what their clusters are like, as one result."""
    r = _records(spark, sf_dir)
    users = segment.user_sets(r).withColumn("seq", F.col("user_id").cast("long"))
    d = summaries.segment_summaries(r, users, "jaccard", 0.6)
    return d.withColumn("sources", F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), ","))
