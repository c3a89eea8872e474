"""Evidence swapped for other records: does groundedness notice?

Records of a cluster stand in a ring, in the order of a hash. An entry that swaps n records for others
begins at a place of its own and takes the first n that it doesn't have already; as it has m of them, the
n + m records from its place on are enough to look at. The ring is cut into arcs at least that long, each kept
with the next one, so an entry meets one row for each trial, and never all records of a cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..session import written

# The fields whose evidence is swapped.
SWAPPED_FIELDS = ("goals.", "pains.", "motivations.", "objections.")
#: Records of an arc, at least, where the ring has as many.
ARC = 16


def swappable(path: Column) -> Column:
    out = F.lit(False)
    for p in SWAPPED_FIELDS:
        out = out | path.startswith(p)
    return out


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"))


def ring(records: DataFrame, seed: int) -> DataFrame:
    """(cluster, record_id, position, size) of distinct records; ranks come without a sort of a cluster
    in one task."""
    r = records.select("cluster", "record_id").distinct().withColumn("h", _hash(F.lit(seed), F.col("record_id")))
    return ranks.positions(r, ["cluster"], ["h", "record_id"]).drop("h")


def _arcs(places: DataFrame, least: int) -> DataFrame:
    """(cluster, arc, arcs, size, first, ids): a ring's arcs of ``least`` to twice as many records (one arc, where
    it has fewer), each with the ids of the next arc, or of the same if there is only one."""
    n = F.greatest(F.lit(1).cast("bigint"), F.expr(f"size div {least}"))
    d = places.withColumn("arcs", n).withColumn("arc", F.expr("position * arcs div size"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "record_id"))), lambda x: x["record_id"])
    own = written(d.groupBy("cluster", "arc", "arcs", "size").agg(F.min("position").alias("first"), listed.alias("ids")))  # fewer than 2 * least
    after = own.select("cluster", ((F.col("arc") + F.col("arcs") - 1) % F.col("arcs")).alias("arc"), F.col("ids").alias("more"))
    return own.join(after, ["cluster", "arc"]).withColumn("ids", F.concat("ids", "more")).drop("more")


def _swapped(e: DataFrame, records: DataFrame, trials: int, seed: int) -> DataFrame:
    """Rows of ``e`` for each trial, with ``new``: the ids in place of its own; null where there are none."""
    e = written(e).withColumns({"own": F.array_distinct("record_ids"), "n": F.size("record_ids")})
    places = ring(records, seed)
    size = places.groupBy("cluster").agg(F.max("size").alias("size"))
    least = max(ARC, e.agg(F.max(F.col("n") + F.size("own"))).first()[0] or 0)
    chosen = F.coalesce(swappable(F.col("path")) & (F.col("n") > 0), F.lit(False))
    each = e.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).join(F.broadcast(size), "cluster", "left")  # a row a cluster
    place = F.conv(F.substring(_hash(F.lit(seed), F.col("trial"), F.col("persona"), F.col("path")), 1, 8), 16, 10).cast("bigint") % F.col("size")
    each = each.withColumn("place", F.when(chosen & F.col("size").isNotNull(), place))
    met = each.where("place is not null").withColumn("arc", F.expr(f"place * greatest(1, size div {least}) div size"))
    met = met.drop("size").join(_arcs(places, least), ["cluster", "arc"])
    look = F.slice("ids", (F.col("place") - F.col("first") + 1).cast("int"), F.least(F.col("n") + F.size("own"), F.col("size").cast("int")))
    new = F.slice(F.filter(look, lambda r: ~F.array_contains("own", r)), F.lit(1), F.col("n"))
    names = ["trial", *e.columns]
    kind = F.lit(None).cast(f"array<{records.schema['record_id'].dataType.simpleString()}>")
    met = met.withColumn("new", new).select(*names, F.when(F.size("new") > 0, F.col("new")).alias("new"))
    return met.unionByName(each.where("place is null").select(*names, kind.alias("new")))


def swap_within(evidence: DataFrame, records: DataFrame, trials: int = 10, seed: int = 42) -> DataFrame:
    """(trial, persona, path, record_ids, swapped): evidence (persona, cluster, path, record_ids) with the ids of
    swappable fields replaced, for each trial anew, by as many others of the cluster as there are;
    where it has no others, and in other fields, the ids stay."""
    d = _swapped(evidence.select("persona", "cluster", "path", "record_ids"), records, trials, seed)
    return d.select("trial", "persona", "path", F.coalesce("new", "record_ids").alias("record_ids"), F.col("new").isNotNull().alias("swapped"))


def swap_across(evidence: DataFrame, records: DataFrame, foreign: DataFrame) -> DataFrame:
    """(persona, path, record_ids): all ids replaced by the first of another cluster's records, round and
    round; foreign: (cluster, other). A persona without another cluster has no rows."""
    r = ranks.positions(records.select("cluster", "record_id").distinct(), ["cluster"], ["record_id"])
    r = r.select(F.col("cluster").alias("other"), F.col("position").alias("place"), "record_id", "size")
    e = evidence.select("persona", "cluster", "path", F.size("record_ids").alias("n")).where("n > 0").join(foreign, "cluster")
    e = e.join(r.select("other", "size").distinct(), "other").withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = e.withColumn("place", F.col("step") % F.col("size")).join(r.drop("size"), ["other", "place"])
    out = met.groupBy("persona", "path").agg(F.array_sort(F.collect_list(F.struct("step", "record_id"))).alias("x"))
    return out.select("persona", "path", F.transform("x", lambda x: x["record_id"]).alias("record_ids"))


def _own_valid(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """Distinct entries, how many are ``alike``, and ``valid``: whether each has ids, all of records that a cluster of
    its persona has."""
    clusters = evidence.groupBy(F.col("persona").alias("of")).agg(F.collect_set("cluster").alias("clusters"))  # of one persona
    holders = records.groupBy(F.col("record_id").alias("held")).agg(F.collect_set("cluster").alias("holders"))
    ids = evidence.select("persona", "cluster", "path", "record_ids").join(clusters, F.col("persona").eqNullSafe(F.col("of")))
    ids = ids.withColumn("id", F.explode_outer("record_ids")).join(holders, F.col("id") == F.col("held"), "left")
    found = F.coalesce(F.arrays_overlap("clusters", "holders"), F.lit(False))
    d = ids.groupBy("persona", "cluster", "path", "record_ids").agg(F.count("*").alias("rows"), F.min(found).alias("valid"))
    return d.withColumn("alike", F.expr("rows div greatest(1, coalesce(size(record_ids), 0))")).drop("rows")


def false_passes(claims: DataFrame, evidence: DataFrame, records: DataFrame, trials: int = 10, seed: int = 42) -> DataFrame:
    """(persona, trials, swapped, passes, false_pass_rate): how often groundedness passes although the
    evidence was swapped within the cluster; claims (persona, path), evidence as in :func:`swap_within`.

    Ids that are swapped in are of the cluster's records, so they are valid; those that stay are the same in
    all trials and are looked up once. All rows of a persona then meet in one shuffle."""
    s = _swapped(_own_valid(evidence, records), records, trials, seed)
    none = F.lit(None)
    entries = s.select("persona", "path", "trial", F.when(F.col("path").isNotNull(), F.col("new").isNotNull() | F.col("valid")).alias("ok"), F.when(F.col("new").isNotNull(), F.col("alike")).alias("swapped"), F.lit(0).alias("claim"))
    own = claims.select("persona", "path", none.cast("int").alias("trial"), none.cast("boolean").alias("ok"), none.cast("bigint").alias("swapped"), F.lit(1).alias("claim"))
    passed = [f"ok_{t}" for t in range(trials)]
    of_path = entries.unionByName(own).repartition("persona").groupBy("persona", "path").agg(
        F.sum("claim").alias("claims"), F.sum("swapped").alias("swapped"), *(F.max(F.when(F.col("trial") == t, F.col("ok"))).alias(c) for t, c in enumerate(passed))
    )
    d = of_path.groupBy("persona").agg(F.sum("claims").alias("claims"), F.coalesce(F.sum("swapped"), F.lit(0)).alias("swapped"), *(F.sum(F.when(F.col(c), F.col("claims")).otherwise(0)).alias(c) for c in passed))
    passes = sum((F.when(F.col(c) / F.col("claims") >= 0.9, 1).otherwise(0) for c in passed), F.lit(0)).cast("bigint")
    d = d.where("claims > 0").select("persona", F.lit(trials).cast("bigint").alias("trials"), "swapped", passes.alias("passes"))
    return d.withColumn("false_pass_rate", F.col("passes") / F.col("trials"))
