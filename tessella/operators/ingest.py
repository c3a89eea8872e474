"""Ingest: policy gate, windows, first sightings, reply edges, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Basis of collection, and whether records may be collected and inferred from.
POLICIES = (
    ("reddit", "public_permitted", True, False),
    ("x", "blocked", False, False),
    ("discord", "consented", True, True),
    ("twitch", "public_permitted", True, True),
    ("facebook", "blocked", False, False),
    ("instagram", "blocked", False, False),
    ("web", "public_permitted", True, False),
    ("linkedin", "consented", True, False),
)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POLICIES), "platform string, basis string, allow_collect boolean, allow_infer boolean")


def policy_gate(targets: DataFrame) -> DataFrame:
    """Each target (platform, basis, wants_inference) with its effective basis and why it is refused.

    A basis of the target's own counts before the platform's; the web has none of its own, so
    without one it is blocked; inference on linkedin needs owned or consented data."""
    p = policies(targets.sparkSession).select(F.col("platform").alias("p"), F.col("basis").alias("default_basis"), "allow_collect", "allow_infer")
    d = targets.join(F.broadcast(p), F.col("platform") == F.col("p"), "left")  # eight rows
    basis = F.when((F.col("platform") == "web") & F.col("basis").isNull(), "blocked").otherwise(F.coalesce("basis", "default_basis", F.lit("blocked")))
    d = d.withColumn("effective_basis", basis)
    infer = F.when(F.col("platform") == "linkedin", F.col("effective_basis").isin("owned", "consented")).otherwise(F.col("allow_infer"))
    reason = (
        F.when(F.col("p").isNull(), "unknown platform")
        .when((F.col("effective_basis") == "blocked") | ~F.col("allow_collect"), "collection blocked")
        .when(F.col("wants_inference") & ~infer, "inference blocked")
        .otherwise("")
    )
    return d.withColumn("refused", reason).drop("p", "default_basis", "allow_collect", "allow_infer")


def in_window(at: Column, since: Column, until: Column) -> Column:
    """Both ends belong to the window; a null end is open."""
    return (since.isNull() | (at >= since)) & (until.isNull() | (at <= until))


def window_or_all(df: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Rows that ``keep``s hold for; of groups without one, all rows."""
    any_kept = F.max(keep.cast("int")).over(Window.partitionBy(*by))
    return df.withColumn("__any", any_kept).where(keep | (F.col("__any") == 0)).drop("__any")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by partial aggregation rather than a sort of each group."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("x")
    return df.groupBy(*key).agg(first).select(*key, "x.*")


def reply_edges(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, role, parent_role) for each turn that answers another speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = turns.select("conv_id", "turn", "role", F.lag("turn").over(w).alias("parent_turn"), F.lag("role").over(w).alias("parent_role"))
    return d.where("parent_turn is not null and role <> parent_role")


def high_water(df: DataFrame, by: list[str], *at: str) -> DataFrame:
    """The next cursor of each source: the latest of the first non-null of these columns."""
    return df.groupBy(*by).agg(F.max(F.coalesce(*at)).alias("cursor"), F.count("*").alias("n"))


def since_cursor(df: DataFrame, cursor: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows at or after their source's cursor; sources without one come whole."""
    return df.join(cursor.select(*by, "cursor"), by, "left").where(F.col("cursor").isNull() | (F.col(at) >= F.col("cursor"))).drop("cursor")


def body_or_fallback(body: Column, embeds: Column, attachments: Column) -> Column:
    """A message's text; if blank, the descriptions (else titles) of its embeds, else the names of its
    attachments; null if there is nothing. ``embeds`` is array<struct<description,title>>."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    said = lambda e: F.coalesce(F.when(e["description"] != "", e["description"]), e["title"], F.lit(""))
    from_embeds = F.trim(F.array_join(F.transform(F.coalesce(embeds, F.array()), said), " "))
    names = F.array_join(F.coalesce(attachments, F.array().cast("array<string>")), " ")
    found = F.when(~blank(body), body).when(~blank(from_embeds), from_embeds).otherwise(names)
    return F.when(~blank(found), found)


def replies(messages: DataFrame) -> DataFrame:
    """(message_id, source_user_id, target_user_id, parent_id) of messages that answer another user's
    message; an unknown parent has no user."""
    parents = messages.select(F.col("message_id").alias("parent_id"), F.col("author_id").alias("target_user_id"))
    d = messages.where("reply_to_message_id is not null").select("message_id", F.col("author_id").alias("source_user_id"), F.col("reply_to_message_id").alias("parent_id"))
    return d.join(parents, "parent_id", "left").where("target_user_id is null or target_user_id <> source_user_id").select("message_id", "source_user_id", "target_user_id", "parent_id")


def mentions(messages: DataFrame) -> DataFrame:
    """(message_id, source_user_id, target_user_id) for each mention (array<struct<id,bot>>) of another
    user who is no bot."""
    d = messages.select("message_id", F.col("author_id").alias("source_user_id"), F.explode("mentions").alias("m"))
    return d.where("m.id <> source_user_id and not coalesce(m.bot, false)").select("message_id", "source_user_id", F.col("m.id").alias("target_user_id"))


def js_shell(html: Column, n_messages: Column) -> Column:
    """Whether a page is a script's shell: a framework's mark, or five scripts and hardly any text."""
    low = F.lower(html)
    marks = ('id="__next"', "data-reactroot", "window.__nuxt__", "__next_data__")
    scripts = F.regexp_count(low, F.lit("<script"))
    visible = F.length(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")))
    marked = F.lit(False)
    for m in marks:
        marked = marked | low.contains(m)
    return marked | ((scripts >= 5) & (n_messages < 2) & (visible < 1200))
