"""Connected components over a table of links, by union-find as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node that can
    be reached, and has no row of its own.

    Each node holds pointers to smaller nodes. A round hooks all its pointers under the smallest
    one and lets each node point to where its target points (pointer jumping), so chains halve.
    The rounds go on until nothing changes; each is a written table. Pointers to a large root meet
    only in joins whose sides are plain exchanges, which adaptive execution splits when skewed.
    Nulls and self-links are ignored.
    """
    up = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("p"))
        .distinct(),
        "cc-links",
    )
    while True:
        low = materialize(up.groupBy("v").agg(F.min("p").alias("m")), "cc-low")
        above = low.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        jumped = low.join(above, "m", "left").select(
            "v", F.coalesce("mm", "m").alias("p"), F.col("mm").isNotNull().alias("moved")
        )
        hooked = (
            up.join(low, "v")
            .where(F.col("p") != F.col("m"))
            .select(F.col("p").alias("v"), F.col("m").alias("p"), F.lit(True).alias("moved"))
        )
        new = materialize(
            jumped.unionByName(hooked).groupBy("v", "p").agg(F.max("moved").alias("moved")), "cc-up"
        )
        changed = not new.where("moved").isEmpty()
        discard(low, up)
        if not changed:
            return new.select(F.col("v").alias("node"), F.col("p").alias("root"))
        up = new
