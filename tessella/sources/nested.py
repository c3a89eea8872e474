"""Leaves of nested payloads, by a recursive query over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept

#: Spark's own bound on the rows of a recursive query; a payload table has as many as it has.
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
LEVELS = 100

_WALK = """
with recursive nodes(id, path, name, value) max recursion level {levels} as (
  select id, cast(array() as array<int>), cast(null as string), value from {roots}
  union all
  select n.id, array_append(n.path, e.pos), e.key, e.value from nodes n, lateral variant_explode(n.value) e
)
select id, path, name, value, schema_of_variant(value) as kind from nodes
"""


def nodes(df: DataFrame, ids: list[str], payload: Column) -> DataFrame:
    """id (a struct of ``ids``), path array<int>, name, value, kind: every value inside a payload (VARIANT
    or JSON text) and the payload itself. A path is the place in each array or object on the way; the
    members of an object come by name. Ordered by path, nodes are in depth-first order. A text that
    isn't JSON has no nodes; a payload nested more than ``LEVELS`` deep is an error."""
    spark = df.sparkSession
    value = payload if df.select(payload.alias("x")).schema["x"].dataType.simpleString() == "variant" else F.try_parse_json(payload)
    roots = df.select(F.struct(*ids).alias("id"), value.alias("value")).where("value is not null")
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        found = spark.sql(_WALK.format(levels=LEVELS, roots="{roots}"), roots=roots)
        # a leaf is needed as text only; VARIANT values aren't kept
        scalar = ~F.col("kind").startswith("OBJECT") & ~F.col("kind").startswith("ARRAY")
        text = F.when(scalar, F.expr("try_variant_get(value, '$', 'string')"))
        return kept(found.select("id", "path", "name", "kind", text.alias("text")))
    finally:
        spark.conf.set(ROW_LIMIT, before)


def _numbered(found: DataFrame, ids: list[str], order: Column) -> DataFrame:
    """Positions within each payload; a payload's leaves are one row's own, so they meet in one task."""
    rows = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("text")))).alias("x"))
    return rows.select("id", F.posexplode(F.transform("x", lambda r: r["text"])).alias("position", "value")).select(*(F.col(f"id.{c}").alias(c) for c in ids), "position", "value")


def string_values(df: DataFrame, ids: list[str], payload: Column) -> DataFrame:
    """``ids``, position, value: the strings inside each payload, depth first; names, numbers and booleans
    don't count, and neither does a string that looks like an object count as one."""
    return _numbered(nodes(df, ids, payload).where("kind = 'STRING'"), ids, F.col("path"))


def flat_texts(df: DataFrame, ids: list[str], payload: Column) -> DataFrame:
    """``ids``, position, value: names and all values but nulls as text, each name before its value."""
    n = nodes(df, ids, payload)
    # the name of a node comes before all that is in it, and behind what was before it
    names = n.where("name is not null").select("id", "path", F.lit(0).alias("k"), F.col("name").alias("text"))
    values = n.where("text is not null").select("id", "path", F.lit(1).alias("k"), "text")
    return _numbered(names.unionByName(values), ids, F.struct("path", "k"))
