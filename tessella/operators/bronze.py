"""Bronze records: seven types in one wide frame, their checks, and how they become flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# What each record type must have, and which of its columns are times.
REQUIRED = {
    "account": ("platform_user_id", "username", "first_observed_at"),
    "profile_snapshot": ("platform_user_id", "snapshot_at"),
    "community": ("community_id", "community_name", "community_type", "observed_at"),
    "thread": ("thread_id", "community_id", "title", "created_at", "observed_at"),
    "message": ("message_id", "thread_id", "community_id", "author_platform_user_id", "body", "created_at", "observed_at"),
    "interaction": ("interaction_type", "source_user_id", "target_user_id", "message_id", "thread_id", "community_id", "created_at"),
    "tombstone": ("tombstone_type", "target_record_type", "target_record_id", "observed_at", "reason"),
}
COMMON = ("platform", "crawl_run_id")
COLUMNS = tuple(dict.fromkeys(["record_type", *COMMON, *(c for cs in REQUIRED.values() for c in cs), "reply_to_message_id", "reply_to_user_id"]))


def widen(df: DataFrame) -> DataFrame:
    """All bronze columns as strings, missing ones null."""
    return df.select(*(F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def errors(df: DataFrame) -> DataFrame:
    """``df`` with an array of what is wrong with each record: blank required columns, times that
    aren't ISO, unknown types."""
    checks = [F.when(_blank(c), f"{c} is blank") for c in COMMON]
    for kind, columns in REQUIRED.items():
        own = F.col("record_type") == kind
        checks += [F.when(own & _blank(c), f"{c} is blank") for c in columns]
        checks += [F.when(own & ~_blank(c) & ~F.col(c).contains("T"), f"{c} is no time") for c in columns if c.endswith("_at")]
    checks.append(F.when(~F.coalesce(F.col("record_type").isin(*REQUIRED), F.lit(False)), "unknown record type"))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def flat_records(bronze: DataFrame, tenant_id: str) -> DataFrame:
    """Flat records of threads, messages, interactions, accounts and profiles; communities and
    tombstones give none."""
    b = bronze.where(F.col("record_type").isin("thread", "message", "interaction", "account", "profile_snapshot"))
    body = F.concat_ws(" ", "title", "body")
    user = F.coalesce("author_platform_user_id", "source_user_id", "platform_user_id")
    behavior = (
        F.when(F.col("record_type") == "thread", "started_thread")
        .when(F.col("record_type") == "message", F.when(F.col("reply_to_message_id").isNotNull(), "replied").otherwise("posted"))
        .when(F.col("record_type") == "interaction", F.col("interaction_type"))
        .otherwise(F.col("record_type"))
    )
    link = F.when(text.has_link(F.lower(body)), "shared_link")
    own = F.coalesce("message_id", "thread_id", "platform_user_id")
    return b.select(
        F.concat_ws(":", *(text.slug(c) for c in (F.col("platform"), F.col("record_type"), F.col("crawl_run_id"), own))).alias("record_id"),
        F.lit(tenant_id).alias("tenant_id"),
        F.col("platform").alias("source"),
        F.coalesce("created_at", "observed_at", "snapshot_at", "first_observed_at").alias("timestamp"),
        user.alias("user_id"),
        F.array_distinct(F.concat(F.array_compact(F.array(behavior, link)), text.tags(body))).alias("behaviors"),
        F.array_compact(F.array(F.when(F.col("community_id").isNotNull(), F.concat(F.lit("/"), text.slug(F.col("community_id")), F.coalesce(F.concat(F.lit("/"), text.slug(F.col("thread_id"))), F.lit("")))))).alias("pages"),
        F.create_map(F.lit("text"), text.none_if_blank(body)).alias("payload"),
        F.lit("1.0").alias("schema_version"),
    )
