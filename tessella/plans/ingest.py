"""Queries of the ingest side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest
from ..sources.records import event_records, table
from . import query

#: The flat records in SQL, for the twins of other queries.
RECORDS = """records as (select 'ev_' || cast(event_id as varchar) as record_id, 't' || cast(user_id % 4 as varchar) as tenant_id,
  case when event_type in ('click','view') then 'ga4' when event_type in ('signup','purchase') then 'hubspot' else 'intercom' end as source,
  cast(user_id as varchar) as user_id, event_type, event_type || '_' || cast(cast(regexp_extract(props, '[0-9]+') as integer) % 8 as varchar) as tagged,
  '/k/' || regexp_extract(props, '[0-9]+') as page, value, regexp_extract(props, '[0-9]+') as k, event_id as seq, ts from events)"""


@query(f"with {RECORDS} select record_id, tenant_id, source, user_id, event_type || ',' || tagged as behaviors, page, cast(round(value * 100) as bigint) as cents from records")
def flat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_records(table(spark, sf_dir, "events"))
    return r.select(
        "record_id", "tenant_id", "source", "user_id", F.array_join("behaviors", ",").alias("behaviors"), F.col("pages")[0].alias("page"),
        F.round(F.col("payload")["session_duration"].cast("double") * 100).cast("bigint").alias("cents"),
    )


@query("""select doc_id, substr(sha256(cast(doc_id as varchar) || '::' || source), 1, 16) as stable_id,
  'item_' || substr(sha256(lang || '|' || source || '|' || cast(doc_id as varchar)), 1, 10) as item_id from documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    return d.select("doc_id", text.stable_id(i, F.col("source")).alias("stable_id"), text.stable_id(F.col("lang"), F.col("source"), i, sep="|", digits=10, prefix="item_").alias("item_id"))


@query("""select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
  case when regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) in ('', '/') then null else regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) end as path from pages""")
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.expr("try_parse_url(url, 'PATH')")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.expr("try_parse_url(url, 'HOST')").alias("host"), text.slug(F.col("url")).alias("slug"), F.when(~p.isin("", "/"), p).alias("path")
    )


@query("""with x as (select conv_id, turn, role, lag(turn) over w as parent_turn, lag(role) over w as parent_role from conversations
  window w as (partition by conv_id order by turn)) select * from x where parent_turn is not null and role <> parent_role""")
def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reply_edges(table(spark, sf_dir, "conversations"))


@query("""with x as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events)
  select user_id, event_id, event_type from x where n = 1""")
def first_seen_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(f"with {RECORDS} select source, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) as cursor, count(*) as n from records group by source")
def incremental_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.high_water(event_records(table(spark, sf_dir, "events")), ["source"], "timestamp")


@query("""with x as (select user_id, event_id, ts between timestamp '2024-01-10 00:00:00' and timestamp '2024-01-10 12:00:00' as k from events),
  y as (select *, max(case when k then 1 else 0 end) over (partition by user_id) as any_kept from x) select user_id, event_id from y where k or any_kept = 0""")
def window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    keep = ingest.in_window(F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp"), F.lit("2024-01-10 12:00:00").cast("timestamp"))
    return ingest.window_or_all(e, ["user_id"], keep).select("user_id", "event_id")


@query("""with p(platform, d, c, i) as (values ('reddit','public_permitted',true,false),('x','blocked',false,false),('discord','consented',true,true),
  ('twitch','public_permitted',true,true),('facebook','blocked',false,false),('instagram','blocked',false,false),('web','public_permitted',true,false),('linkedin','consented',true,false)),
  t as (select doc_id, case doc_id % 9 when 0 then 'reddit' when 1 then 'x' when 2 then 'discord' when 3 then 'twitch' when 4 then 'facebook' when 5 then 'instagram' when 6 then 'web' when 7 then 'linkedin' else 'myspace' end as platform,
  case doc_id % 4 when 0 then 'owned' when 1 then 'consented' else null end as basis, doc_id % 2 = 0 as wants from documents),
  e as (select t.*, p.platform as known, p.c, p.i, case when t.platform = 'web' and basis is null then 'blocked' else coalesce(basis, p.d, 'blocked') end as eff from t left join p on t.platform = p.platform)
  select doc_id, platform, eff as effective_basis, case when known is null then 'unknown platform' when eff = 'blocked' or not c then 'collection blocked'
  when wants and not (case when platform = 'linkedin' then eff in ('owned','consented') else i end) then 'inference blocked' else '' end as refused from e""")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*(p[0] for p in ingest.POLICIES[:6]), "web", "linkedin", "myspace"]
    pick = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("doc_id") % 9 + 1).cast("int"))
    t = table(spark, sf_dir, "documents").select(
        "doc_id", pick.alias("platform"), F.when(F.col("doc_id") % 4 == 0, "owned").when(F.col("doc_id") % 4 == 1, "consented").alias("basis"), (F.col("doc_id") % 2 == 0).alias("wants_inference")
    )
    return ingest.policy_gate(t).select("doc_id", "platform", "effective_basis", "refused")


def _tag_case(name: str, words: tuple[str, ...]) -> str:
    return f"case when {' or '.join(f"contains(p, '{w}')" for w in words)} then 'topic_{name}' end"


@query(f"""with x as (select doc_id, ' ' || trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) || ' ' as p from documents)
  select doc_id, concat_ws(',', {', '.join(_tag_case(k, v) for k, v in text.TOPICS.items())}) as tags,
  contains(p, 'http://') or contains(p, 'https://') or contains(p, 'www.') as has_link from x""")
def topic_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.tags(F.col("text")), ",").alias("tags"), text.has_link(F.lower("text")).alias("has_link"))


_SHOUT = "length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 20 and length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"
BOTS = ("Ann has joined the channel", "hello there, @here", "READ ALL THE RULES BEFORE POSTING", "[BOT] done", "You've been added to it", "an ordinary sentence", "Reminder: pay", "Nobody pinned a message today", "pinned notes", "OK FINE")

_BOTS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in BOTS) + "]"


@query(f"""with x as (select conv_id, turn, ({_BOTS})[(conv_id * 3 + turn) % {len(BOTS)} + 1] || case when turn % 2 = 0 then ' ' || left(text, 5) else '' end as text from conversations)
  select turn % 2 as half, count(*) as n, count(case when regexp_matches(text, '(?i){"|".join(text.BOT_PATTERNS).replace("'", "''")}') or ({_SHOUT}) then 1 end) as n_bot from x group by 1""")
def bot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that bots and people write, some before a bit of other text."""
    c = table(spark, sf_dir, "conversations")
    pick = F.element_at(F.array(*(F.lit(x) for x in BOTS)), ((F.col("conv_id") * 3 + F.col("turn")) % len(BOTS) + 1).cast("int"))
    d = c.select((F.col("turn") % 2).alias("half"), F.concat(pick, F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.substring("text", 1, 5))).otherwise("")).alias("text"))
    return d.groupBy("half").agg(F.count("*").alias("n"), F.count_if(text.is_bot(F.col("text"))).alias("n_bot"))


@query("""with m as (select conv_id * 100 + turn as id, conv_id % 7 as author, case when turn % 3 > 0 then conv_id * 100 + turn - 1 - turn % 2 end as parent, turn from conversations),
  r as (select 'reply' as kind, m.id, m.author, p.author as target from m left join m p on p.id = m.parent where m.parent is not null and (p.author is null or p.author <> m.author)),
  t as (select 'mention' as kind, id, author, (author + k) % 7 as target from m, (values (0), (1), (3)) v(k) where (author + k) % 7 <> author and not (k = 3 and turn % 2 = 0)) select kind, id, author, target from r union all select * from t""")
def interaction_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and mentions between seven users."""
    k, turn = F.col("conv_id") * 100 + F.col("turn"), F.col("turn")
    author = F.col("conv_id") % 7
    named = F.array(*(F.struct(((author + i) % 7).alias("id"), (F.lit(i == 3) & (turn % 2 == 0)).alias("bot")) for i in (0, 1, 3)))
    m = table(spark, sf_dir, "conversations").select(k.alias("message_id"), author.alias("author_id"), F.when(turn % 3 > 0, k - 1 - turn % 2).alias("reply_to_message_id"), named.alias("mentions"))
    rows = lambda kind, d: d.select(F.lit(kind).alias("kind"), F.col("message_id").alias("id"), F.col("source_user_id").alias("author"), F.col("target_user_id").alias("target"))
    return rows("reply", ingest.replies(m)).unionByName(rows("mention", ingest.mentions(m)))


@query("""with x as (select page_id, lower(html) as low, html from pages), y as (select page_id, low, (length(low) - length(replace(low, '<script', ''))) / 7 as scripts, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) as visible from x)
  select page_id, contains(low, 'id="__next"') or contains(low, 'data-reactroot') or contains(low, 'window.__nuxt__') or contains(low, '__next_data__') or (scripts >= 5 and page_id % 4 < 2 and visible < 1200) as shell from y""")
def js_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ingest.js_shell(F.col("html"), F.col("page_id") % 4).alias("shell"))


@query("""with x as (select conv_id, turn, trim(text) as t from conversations), y as (select *, row_number() over (partition by conv_id, t order by turn) as n from x where length(t) between 20 and 2000)
  select conv_id, turn, length(t) as n_chars from y where n = 1""")
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("t")).where(F.length("t").between(20, 2000))
    return ingest.first_seen(c, ["conv_id", "t"], ["turn"]).select("conv_id", "turn", F.length("t").cast("bigint").alias("n_chars"))
