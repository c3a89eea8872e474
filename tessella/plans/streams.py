"""Queries over windows of time; batch runs of the streaming functions, so SQL can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import table
from ..streaming import events as stream
from . import query

FORMAT = "yyyy-MM-dd HH:mm:ss"


def _utc(c: str):
    return F.date_format(c, FORMAT).alias(c)


@query("""select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, cast(round(sum(value) * 100) as bigint) as total_cents from events group by 1, 2""")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stream.tumbling(table(spark, sf_dir, "events"), "1 hour")
    return d.select(_utc("start"), "event_type", "n", F.round(F.col("total") * 100).cast("bigint").alias("total_cents"))


@query("""with e as (select date_trunc('hour', ts) as h from events), x as (select h as start from e union all select h - interval 1 hour from e) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from x group by 1""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(table(spark, sf_dir, "events"), "2 hours", "1 hour").select(_utc("start"), "n")


@query("""with a as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from a)
  select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, count(*) as n from s group by user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", _utc("start"), _utc("last"), "n")
