"""Queries over feeds: tables that are written as channels and read by cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import feed, nested, threads
from ..sources.records import RECORD, event_records, table
from ..streaming import monitor
from . import query
from .ingest import RECORDS

SINCE = "2024-01-15T00:00:00"


@query(f"""with {RECORDS} select record_id, tenant_id, source, strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, user_id, event_type || ',' || tagged as behaviors, page,
  k as payload_k, cast(round(value * 100) as bigint) as cents from records where source in ('ga4', 'hubspot') and strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '{SINCE}'""")
def connector_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a feed of one channel a source, of which two are fetched from a cursor on."""
    path = shared_folder(spark, "feed")
    records = event_records(table(spark, sf_dir, "events")).select(*RECORD.names)
    feed.write_feed(records, path, run="events")
    d = feed.read_feed(spark, path, where=F.col("source").isin("ga4", "hubspot") & (F.col("timestamp") >= SINCE))
    return d.select(
        "record_id", "tenant_id", "source", "timestamp", "user_id", F.array_join("behaviors", ",").alias("behaviors"), F.col("pages")[0].alias("page"),
        F.col("payload")["k"].alias("payload_k"), F.round(F.col("payload")["session_duration"].cast("double") * 100).cast("bigint").alias("cents"),
    )


@query(f"""with {RECORDS} select record_id, source, user_id, case when strftime(ts, '%Y-%m-%dT%H:%M:%S') < '{SINCE}' then 1 else 2 end as pass from records""")
def connector_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream, read up to where it is and, after more has come, from the cursor on. Each
    pass enters its rows in a second feed, once."""
    path, out, state = (shared_folder(spark, x) for x in ("feed", "passes", "cursor"))
    records = event_records(table(spark, sf_dir, "events")).select(*RECORD.names)
    schema = "record_id string, source string, user_id string, timestamp string, pass int"
    for number, part in enumerate((F.col("timestamp") < SINCE, F.col("timestamp") >= SINCE), 1):
        feed.write_feed(records.where(part), path, run="events", batch=str(number))
        rows = feed.read_increments(spark, path).select("record_id", "source", "user_id", "timestamp", F.lit(number).alias("pass"))
        feed.record_stream(rows, out, run="passes", checkpoint=state).awaitTermination()
    return feed.read_feed(spark, out, schema).select("record_id", "source", "user_id", "pass")


_FROM_TEXT = "trim(regexp_replace(text, '[\\x09-\\x0D\\x20]+', ' ', 'g'))"
OBSERVED = "2026-04-09T12:00:00Z"


def thread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a forum's page: a post a turn, which answers the turn two before it."""
    c = table(spark, sf_dir, "conversations")
    k, turn = F.col("conv_id") * 100 + F.col("turn"), F.col("turn")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    answer = F.when(turn >= 2, F.concat(F.lit(' data-reply-to-id="'), (k - 2).cast("string"), F.lit('"'))).otherwise("")
    post = F.format_string(
        '<article class="topic-post" data-post-id="post-%s"%s><header><a class="username">%s</a><time datetime="2026-04-0%sT10:00:00+02:00"></time></header><div class="cooked"><p>%s</p></div></article>',
        k.cast("string"), answer, F.concat("role", (F.col("conv_id") % 3).cast("string")), (1 + turn % 7).cast("string"), escaped,
    )
    page = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", post.alias("post")))).alias("p"))  # of one conversation
    body = F.array_join(F.transform("p", lambda x: x["post"]), "\n")
    html = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"/><title>A thread</title></head><body><main>'), body, F.lit("</main></body></html>"))
    return page.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("https://forum.example.com/t/"), F.col("conv_id").cast("string")).alias("url"), html.alias("html"))


@query(f"""with t as (select conv_id, turn, conv_id * 100 + turn as k, role || cast(conv_id % 3 as varchar) as author, {_FROM_TEXT} as p from conversations),
  b as (select *, case when length(p) >= 20 then p else trim(author || ' ' || p) end as body from t), kept as (select * from b where length(body) >= 24)
  select x.conv_id as page_id, row_number() over (partition by x.conv_id order by x.turn) - 1 as position, cast(x.k as varchar) as message_id,
  'web-user-' || substr(sha256('forum.example.com::' || x.author), 1, 16) as author_id, x.author as author_name, md5(x.body) as body,
  '2026-04-0' || cast(1 + x.turn % 7 as varchar) || 'T08:00:00Z' as created_at, case when x.turn >= 2 then cast(x.k - 2 as varchar) end as reply_to_message_id,
  case when y.k is not null then 'web-user-' || substr(sha256('forum.example.com::' || y.author), 1, 16) end as reply_to_user_id
  from kept x left join kept y on y.conv_id = x.conv_id and y.k = x.k - 2 and x.turn >= 2""")
def threaded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts, authors and answers of forum pages."""
    found = threads.page_posts(thread_pages(spark, sf_dir), F.lit(OBSERVED))
    return found.select("page_id", "position", "message_id", "author_id", "author_name", F.md5(F.col("body").cast("binary")).alias("body"), "created_at", "reply_to_message_id", "reply_to_user_id")


@query()
def page_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages have of posts, or else of paragraphs."""
    return threads.page_posts(table(spark, sf_dir, "pages"), F.lit(OBSERVED)).drop("url")


# Nested payloads: leaves depth first, members of an object by name.


@query("""with c as (select conv_id, turn, role, replace(left(text, 12), chr(92), '') as t from conversations), l as (
  select conv_id, turn, 0 as p, 'author' as k, role as v from c union all select conv_id, turn, 1, 'body', t from c
  union all select conv_id, turn, 2, 'deep', 'x' || cast(turn as varchar) from c union all select conv_id, turn, 3, 'deep', '{"no":"object"}' from c
  union all select conv_id, turn, 4, 'deep', role from c where turn % 2 = 0)
  select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by p) - 1 as integer) as position, v as value from l""")
def payload_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.string_values(_payloads(spark, sf_dir), ["conv_id", "turn"], F.col("payload"))


@query("""with c as (select conv_id, turn, role, replace(left(text, 12), chr(92), '') as t from conversations), l as (
  select conv_id, turn, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) as p, unnest(['author', 'n', cast(turn as varchar), 'name', role, 'body', t, 'deep', 'x' || cast(turn as varchar), '{"no":"object"}', case when turn % 2 = 0 then 'k' end]) as v from c
  union all select conv_id, turn, 11, role from c where turn % 2 = 0 union all select conv_id, turn, 12, 'none' from c)
  select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by p) - 1 as integer) as position, v as value from l where v is not null""")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and all values but nulls."""
    return nested.flat_texts(_payloads(spark, sf_dir), ["conv_id", "turn"], F.col("payload"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.replace(F.substring("text", 1, 12), F.lit("\\"), F.lit("")).alias("t"))
    one = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("k")))).otherwise("null")
    deep = F.concat(F.lit('[["x'), F.col("turn").cast("string"), F.lit('", ["{\\"no\\":\\"object\\"}"], '), one, F.lit("]]"))
    author = F.to_json(F.struct(F.col("role").alias("name"), F.col("turn").alias("n")))
    body = F.get_json_object(F.to_json(F.struct("t")), "$")  # {"t":"..."}
    quoted = F.expr("substring(b, 6, length(b) - 6)")
    d = c.withColumn("b", body)
    return d.select("conv_id", "turn", F.concat(F.lit('{"deep":'), deep, F.lit(',"author":'), author, F.lit(',"body":'), quoted, F.lit(',"none":null}')).alias("payload"))


# Drift of scores: the events' values by type, as a stream and as a table.

_DRIFT = """h as (select event_id, event_type, user_id, value, count(*) over w as n, avg(value) over w as m, stddev_pop(value) over w as s from events window w as (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding)),
  z as (select *, case when n >= 3 then (value - m) / greatest(s, 0.01) end as z from h)"""
_CHECKED_SQL = f"with {_DRIFT} select event_type as dimension_id, event_id as score_id, n as history, case when n < 3 then 'insufficient_data' when z < -1 then 'drift_detected' else 'stable' end as status, cast(round(z * 1e4) as bigint) as z_e4 from z"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # ids of one length, so that they order as the numbers do
    return e.select(F.col("event_type").alias("dimension_id"), F.col("user_id").cast("string").alias("persona_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("score_id"), F.col("ts").alias("at"), F.col("value").alias("score"))


def _checked(d: DataFrame) -> DataFrame:
    return d.select("dimension_id", F.col("score_id").cast("bigint").alias("score_id"), "history", "status", F.round(F.col("z_score") * 1e4).cast("bigint").alias("z_e4"))


@query(_CHECKED_SQL)
def drift_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(monitor.check_drift(_scores(spark, sf_dir)))


@query(_CHECKED_SQL)
def drift_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over a feed that grows in two parts."""
    path, out, state = (shared_folder(spark, x) for x in ("scores", "checked", "history"))
    own = _scores(spark, sf_dir).withColumn("at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    keys = {"channel": "dimension_id", "at": "at", "key": "score_id"}
    schema = "dimension_id string, persona_id string, score_id string, at string, score double"
    for number, part in enumerate((F.col("at") < SINCE, F.col("at") >= SINCE)):
        feed.write_feed(own.where(part), path, run="scores", batch=str(number), **keys)
        rows = feed.read_increments(spark, path, schema, **keys).withColumn("at", F.to_timestamp("at"))
        found = monitor.monitor(rows).withColumn("at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        with monitor.rocksdb(spark):
            started = feed.record_stream(found, out, run="checked", checkpoint=state, **keys)
        started.awaitTermination()
    return _checked(feed.read_feed(spark, out, monitor.CHECKED.replace("at timestamp", "at string"), **keys))


@query(f"with {_DRIFT} select cast(user_id as varchar) as persona_id, 'persona' as suite, event_type as dimension_id, event_id as score_id, cast(round(round(abs(z), 2) * 100) as bigint) as dropped_e2 from z where n >= 3 and z < -1")
def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = monitor.alerts(monitor.check_drift(_scores(spark, sf_dir)))
    return d.select("persona_id", "suite", "dimension_id", F.col("score_id").cast("bigint").alias("score_id"), F.round(F.col("dropped") * 100).cast("bigint").alias("dropped_e2"))
