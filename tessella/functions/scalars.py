"""Small scalar functions: times, ages, prices, scores, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds at which snowflake ids begin.
SNOWFLAKE_EPOCH = 1_420_070_400_000
# US dollars for a million tokens in and out, by a part of a model's name, first match first.
PRICES = (("opus", 15.0, 75.0), ("haiku", 1.0, 5.0), ("gpt-5-nano", 0.05, 0.4), ("", 3.0, 15.0))


def snowflake_time(x: Column) -> Column:
    return F.timestamp_millis(F.shiftright(x.cast("long"), 22) + F.lit(SNOWFLAKE_EPOCH))


def iso_time(x: Column, fallback: Column | None = None) -> Column:
    """ISO text normalised to UTC seconds with a Z; text without a zone is UTC."""
    t = F.try_to_timestamp(x)
    out = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.coalesce(out, fallback) if fallback is not None else out


def epoch_time(x: Column) -> Column:
    return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_midpoint(x: Column) -> Column:
    """``lo-hi`` to the rounded mean, ``65+`` to five more, a number to itself; else null."""
    part = lambda p, k: F.regexp_extract(x, p, k).try_cast("int")
    span = r"^\s*(\d+)\s*[-–]\s*(\d+)\s*$"
    return F.coalesce(
        F.bround((part(span, 1) + part(span, 2)) / 2).cast("int"),
        part(r"^\s*(\d+)\s*\+\s*$", 1) + 5,
        part(r"^\s*(\d+)\s*$", 1),
    )


def gender(x: Column) -> Column:
    """Without qualifiers, lower case; a mixed group has none."""
    g = F.trim(F.regexp_replace(F.lower(F.trim(x)), "^(predominantly|mostly|mainly|primarily)\\s+", ""))
    return F.when(g.contains("mixed"), "").otherwise(g)


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    out = None
    for name, a, b in reversed(PRICES):
        price = (tokens_in * a + tokens_out * b) / 1e6
        out = price if out is None else F.when(F.lower(model).contains(name), price).otherwise(out)
    return out


def judge_score(reply: Column, default: float = 3.0) -> Column:
    """The score of a judge's reply: its JSON field, else the first digit of 1 to 5, else the default."""
    found = F.coalesce(F.get_json_object(reply, "$.score"), F.nullif(F.regexp_extract(reply, "([1-5](?:\\.\\d+)?)", 1), F.lit("")))
    return F.coalesce(found.try_cast("double"), F.lit(default))


def unit_score(score: Column) -> Column:
    """1 to 5 onto 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score - 1) / 4))


def word_chunks(x: Column, size: int = 512) -> Column:
    """The text's words in windows of ``size``."""
    w = F.filter(F.split(x, "\\s+"), lambda t: t != "")
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s, F.lit(size)), " "))


def embed(x: Column, dimensions: int = 64) -> Column:
    """A stand-in for a text model: counts of hashed tokens, as a vector."""
    slots = F.transform(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)))
    counted = lambda v, s: F.transform(v, lambda n, i: F.when(i == s, n + 1).otherwise(n))
    return F.aggregate(slots, F.array_repeat(F.lit(0.0), dimensions), counted)
