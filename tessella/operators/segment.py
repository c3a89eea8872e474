"""Segmentation: features of users, schema inference, similarity, clustering, summaries."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, sets, stats, vectors
from ..session import kept

#: (source, payload key, feature name, kind) of the default registry.
REGISTRY = (
    ("ga4", "session_duration", "session_duration", "numeric"),
    ("hubspot", "company_size", "company_size", "categorical"),
    ("hubspot", "industry", "industry", "categorical"),
    ("hubspot", "contact_title", "role", "categorical"),
    ("intercom", "topic", "topic", "categorical"),
)


def user_key(record_id: str = "record_id", user_id: str = "user_id") -> Column:
    """Records without a user, or with an empty one, are users of their own."""
    return F.coalesce(F.when(F.col(user_id) != "", F.col(user_id)), F.concat(F.lit("anon_"), F.col(record_id)))


def user_sets(records: DataFrame) -> DataFrame:
    """(tenant_id, user_id, behaviors, pages, sources: sorted sets, record_ids in order, n_records)."""
    d = records.withColumn("user_id", user_key())
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "record_id"))), lambda x: x["record_id"])
    return d.groupBy("tenant_id", "user_id").agg(
        flat("behaviors").alias("behaviors"), flat("pages").alias("pages"), F.array_sort(F.collect_set("source")).alias("sources"),
        ordered.alias("record_ids"), F.count("*").alias("n_records"),
    )


def payload_features(records: DataFrame, registry=REGISTRY) -> DataFrame:
    """(tenant_id, user_id, seq, name, kind, value) for each registered payload value that is there."""
    spark = records.sparkSession
    reg = spark.createDataFrame(list(registry), "source string, key string, name string, kind string")
    d = records.select("tenant_id", user_key().alias("user_id"), "seq", "source", F.explode("payload").alias("key", "value"))
    return d.join(F.broadcast(reg), ["source", "key"]).where("value is not null").drop("source", "key")  # a row a feature


def numeric_means(features: DataFrame) -> DataFrame:
    """The mean of each user's finite values of each numeric feature, added by seq."""
    x = F.expr("try_cast(trim(value) as double)")
    d = features.where("kind = 'numeric'").withColumn("x", x).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    d = stats.in_order(d.select("tenant_id", "user_id", "name", "seq", "x"), ["tenant_id", "user_id", "name"], ["seq"])
    return d.groupBy("tenant_id", "user_id", "name").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def modes(df: DataFrame, by: list[str], value: str, seq: str = "seq", out: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the first seen."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"), F.min(seq).alias("__first"))
    best = F.max_by(F.struct(F.col(value).alias("v"), F.col("__n").alias("n")), F.struct(F.col("__n"), -F.col("__first"))).alias("x")
    return counted.groupBy(*by).agg(best).select(*by, F.col("x.v").alias(out), F.col("x.n").alias("n"))


# Fixed values of schema inference.
LEAST_RECORDS, MOST_NULLS, NUMERIC_SHARE, ID_UNIQUE, ID_ROWS, ID_SHARE, ID_ABOVE, MOST_VALUES = 5, 0.5, 0.8, 0.9, 10, 0.8, 999, 20
IDENTITY_KEYS = ("user_id", "record_id", "timestamp", "id")


def infer_schema(records: DataFrame, repetition: float = 0.5) -> DataFrame:
    """(key, total, non_null, n_numeric, n_distinct, role) of every payload key, in one pass.

    role: numeric, id (numeric, but nearly unique large integers), categorical, or skip."""
    total = records.select(F.count("*").alias("total"))
    d = records.select(F.explode("payload").alias("key", "value")).where(~F.col("key").isin(*IDENTITY_KEYS) & F.col("value").isNotNull())
    x = F.expr("try_cast(trim(value) as double)")
    whole = (F.col("x") == F.floor("x")) & (F.abs("x") > ID_ABOVE) & (F.abs("x") < F.lit(float("inf")))
    agg = d.withColumn("x", x).groupBy("key").agg(
        F.count("*").alias("non_null"),
        F.count("x").alias("n_numeric"),
        F.count_distinct("value").alias("n_distinct"),
        F.count(F.when(whole, 1)).alias("n_large"),
    )
    agg = agg.crossJoin(F.broadcast(total))  # one row
    numeric = F.col("n_numeric") > NUMERIC_SHARE * F.col("non_null")
    ids = (F.col("n_distinct") > ID_UNIQUE * F.col("non_null")) & (F.col("non_null") >= ID_ROWS) & (F.col("n_large") > ID_SHARE * F.col("n_numeric"))
    repeated = 1 - F.col("n_distinct") / F.col("non_null") >= repetition
    role = (
        F.when(F.col("total") < LEAST_RECORDS, "skip")
        .when(F.col("total") - F.col("non_null") > MOST_NULLS * F.col("total"), "skip")
        .when(numeric & ids, "id")
        .when(numeric, "numeric")
        .when((F.col("n_distinct") <= MOST_VALUES) & repeated, "categorical")
        .otherwise("skip")
    )
    return agg.withColumn("role", role).drop("n_large")


def jaccard_pairs(users: DataFrame, by: str, key: str, items: str, least: float, e6: bool = False) -> DataFrame:
    """(by, a, b, shared, jaccard) of pairs within a group that reach ``least`` (over 0); with ``e6`` jaccard_e6 instead of
    jaccard, in millionths, rounded where pairs are formed, as a column more costs as much as a pair.

    Users meet block by block and a pair is looked at once, in the task that yields it: where items are common
    nearly all pairs share some, and pairs that meet over items would be shuffled once for each."""
    u = users.where(F.col(key).isNotNull()).select(by, F.col(key).alias("u"), F.transform(F.array_distinct(items), lambda x: F.struct(F.lit("").alias("field"), x.alias("item"))).alias("s"))
    kinds = {c: users.schema[c].dataType for c in (by, key)}
    name = "jaccard_e6" if e6 else "jaccard"

    def run(m: blocks.Met) -> Iterator[pa.RecordBatch]:
        for a, b, shared, either in m.pairs("", "u", least) if m.fields else ():
            value = blocks.half_up(shared * 1e6 / either) if e6 else shared / either
            yield pa.RecordBatch.from_arrays([pa.repeat(m.rows[by][0], len(a)), a, b, pa.array(shared), pa.array(value)], [by, "a", "b", "shared", name])

    return blocks.each(blocks.deal(u, [by], "u", "s"), run, f"`{by}` {kinds[by].simpleString()}, a {kinds[key].simpleString()}, b {kinds[key].simpleString()}, shared bigint, {name} {'bigint' if e6 else 'double'}")


def gower_distance(left: str, right: str, numeric: dict[str, float], categorical: list[str], sets_: list[str], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), implicit: tuple[str, ...] = ()) -> Column:
    """Weighted mean distance of two rows (aliases) over the features that both have.

    ``numeric`` has each numeric feature's range; weights are for numeric, categorical, set features.
    Two empty sets say nothing. ``implicit`` sets, such as behaviors and pages, that are equal count
    only for rows that share no numeric or categorical feature of some weight. Nothing shared is
    distance 1."""
    col = lambda t, c: F.col(f"{t}.{c}")
    terms: list[tuple[Column, Column, float]] = []
    for c, spread in numeric.items():
        both = col(left, c).isNotNull() & col(right, c).isNotNull()
        gap = F.lit(0.0) if spread == 0 else F.least(F.abs(col(left, c) - col(right, c)) / spread, F.lit(1.0))
        terms.append((both, gap, weights[0]))
    for c in categorical:
        both = col(left, c).isNotNull() & col(right, c).isNotNull()
        terms.append((both, F.when(col(left, c) == col(right, c), 0.0).otherwise(1.0), weights[1]))
    for c in sets_:
        some = (F.size(col(left, c)) > 0) | (F.size(col(right, c)) > 0)
        terms.append((some, 1 - sets.jaccard(col(left, c), col(right, c)), weights[2]))
    typed = F.lit(False)
    for ok, w in [(ok, weights[0]) for ok, _, _ in terms[: len(numeric)]] + [(ok, weights[1]) for ok, _, _ in terms[len(numeric) : len(numeric) + len(categorical)]]:
        typed = typed | ok if w > 0 else typed
    for c in implicit:
        some = (F.size(col(left, c)) > 0) | (F.size(col(right, c)) > 0)
        apart = 1 - sets.jaccard(col(left, c), col(right, c))
        terms.append((some & ((apart > 0) | ~typed), apart, weights[2]))
    zero = F.lit(0.0)
    total = sum((F.when(ok, d * w).otherwise(zero) for ok, d, w in terms), zero)
    weight = sum((F.when(ok, F.lit(w)).otherwise(zero) for ok, _, w in terms), zero)
    return F.coalesce(F.try_divide(total, weight), F.lit(1.0))


def top_items(df: DataFrame, by: list[str], item: str, k: int, seq: str = "seq") -> DataFrame:
    """The k most frequent items of each group, the first seen before later ones of equal count."""
    counted = df.groupBy(*by, item).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("first")


def style_coherent(df: DataFrame, by: list[str], key: str, signature: str, k: int) -> DataFrame:
    """Of each group the k rows whose mean distance in style to the others is least; ties by key.

    A row's mean distance to all is at least its distance to the group's mean signature, and at most that
    and the mean of all these distances. So rows farther from the mean than the k-th nearest and that
    reach can't be among the k, and only the others are compared with the whole group."""
    mean = vectors.centroids(df.select(*by, F.col(signature).alias("x")), by, "x")
    d = df.select(*by, F.col(key).alias("a"), F.col(signature).alias("x")).join(mean, by)
    d = d.select(*by, "a", "x", vectors.distance(F.col("x"), F.col("centroid")).alias("off"))
    kth = d.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("off"))).where(F.col("n") <= k).groupBy(*by).agg(F.max("off").alias("kth"))
    size = d.groupBy(*by).agg(F.avg("off").alias("reach"), F.count("*").alias("size")).join(kth, by)
    # the mean leaves the row itself out, which makes it larger by size / (size - 1)
    near = d.join(size, by).where(F.col("off") <= (F.col("kth") + F.col("reach")) * F.greatest(F.lit(1.0), F.try_divide(F.col("size"), F.col("size") - 1)) + 1e-9).select(*by, "a", "x")
    b = df.select(*by, F.col(key).alias("b"), F.col(signature).alias("y"))
    means = near.join(b, by).where("a <> b").groupBy(*by, "a").agg(F.avg(vectors.distance(F.col("x"), F.col("y"))).alias("d"))
    means = near.select(*by, "a").join(means, [*by, "a"], "left").fillna(0.0, ["d"])
    w = Window.partitionBy(*by).orderBy(F.round("d", 9), "a")
    return means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("a", key)


#: Users of a tenant that one task of cluster_users() takes, about.
ROUND_USERS = 20_000


def _greedy(users: pd.DataFrame, similarity, threshold: float, clusters: list) -> list[int]:
    """Each user, in order, to the cluster of strictly greatest similarity if that reaches the
    threshold and isn't 0; else to a new one. ``clusters`` are those of the users before."""
    out = []
    for row in similarity.rows(users):
        best, best_s = None, 0.0
        for i in similarity.near(row, clusters):
            s = similarity(row, clusters[i])
            if s > best_s:
                best, best_s = i, s
        if best is None or best_s < threshold:
            clusters.append(similarity.start(row))
            best = len(clusters) - 1
        else:
            similarity.add(row, clusters[best])
        similarity.note(row, best)
        out.append(best)
    return out


class _Jaccard:
    """Similarity of a user's behaviors to the union of a cluster's. A user is compared only with
    clusters that share a behavior, all others having similarity 0."""

    def __init__(self, clusters: list[set]) -> None:
        self.of: dict[str, set[int]] = {}
        for i, c in enumerate(clusters):
            self.note(c, i)

    def rows(self, users):
        return map(set, users["behaviors"])

    def note(self, items: set, i: int) -> None:
        for x in items:
            self.of.setdefault(x, set()).add(i)

    def near(self, items: set, clusters: list) -> list[int]:
        return sorted(set().union(*(self.of.get(x, ()) for x in items)))

    def start(self, items: set):
        return set(items)

    def add(self, items: set, c: set) -> None:
        c |= items

    def __call__(self, items: set, c: set) -> float:
        both = len(items & c)
        return both / (len(items) + len(c) - both)

    @staticmethod
    def dump(c) -> str:
        return json.dumps(sorted(c))

    @staticmethod
    def load(text: str):
        return set(json.loads(text))


class _Gower:
    """1 - Gower distance of a user to a cluster's prototype: unions, means, modes."""

    def __init__(self, ranges: dict[str, float]):
        self.ranges = ranges

    def rows(self, users):
        return users.itertuples(index=False)

    def near(self, row, clusters: list):
        return range(len(clusters))

    def note(self, row, i: int) -> None:
        pass

    def start(self, row):
        c = {"sets": [set(), set()], "num": {}, "cat": {}}
        self.add(row, c)
        return c

    def add(self, row, c):
        c["sets"][0].update(row.behaviors)
        c["sets"][1].update(row.pages)
        for k, v in row.numeric.items():
            s, n = c["num"].get(k, (0.0, 0))
            c["num"][k] = (s + v, n + 1)
        for k, v in row.categorical.items():
            d = c["cat"].setdefault(k, {})
            d[v] = d.get(v, 0) + 1

    def __call__(self, row, c):
        dist = []
        num = [k for k in row.numeric if k in c["num"] and k in self.ranges]
        cat = [k for k in row.categorical if k in c["cat"]]
        for mine, theirs in zip((set(row.behaviors), set(row.pages)), c["sets"], strict=True):
            if mine or theirs:
                d = 1 - len(mine & theirs) / len(mine | theirs)
                if d > 0 or not (num or cat):
                    dist.append(d)
        for k in num:
            s, n = c["num"][k]
            r = self.ranges[k]
            dist.append(min(abs(row.numeric[k] - s / n) / r, 1.0) if r else 0.0)
        for k in cat:
            counts = c["cat"][k]
            dist.append(0.0 if max(counts, key=counts.get) == row.categorical[k] else 1.0)
        return 1 - sum(dist) / len(dist) if dist else 0.0

    def dump(self, c) -> str:
        """JSON, which keeps floats as they are and the order of counts, by which modes tie."""
        return json.dumps({**c, "sets": [sorted(x) for x in c["sets"]]})

    def load(self, text: str):
        c = json.loads(text)
        return {**c, "sets": [set(x) for x in c["sets"]]}


def _in_rounds(users: DataFrame) -> DataFrame:
    """``users`` with their round: a tenant's users in order, cut into runs of about ``ROUND_USERS``.

    A sort by ranges deals users out however many a tenant has; ranges are then joined to rounds."""
    n = users.count()
    d = users.repartitionByRange(max(1, math.ceil(4 * n / ROUND_USERS)), "tenant_id", "order", "seq", "user_id")
    d = kept(d.withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy("tenant_id").orderBy("range")  # a row for each range of a tenant
    ranges = d.groupBy("tenant_id", "range").agg(F.count("*").alias("n"))
    ranges = ranges.select(F.col("tenant_id").alias("t"), F.col("range").alias("r"), F.floor((F.sum("n").over(w) - F.col("n")) / ROUND_USERS).cast("int").alias("round"))
    return d.join(ranges, F.col("tenant_id").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r"))).drop("t", "r", "range")


def cluster_users(users: DataFrame, metric: str = "jaccard", threshold: float = 0.3, min_size: int = 2) -> DataFrame:
    """(tenant_id, cluster, user_id) by greedy clustering of each tenant's users.

    ``users`` has behaviors, pages and seq, and for gower also numeric and categorical maps. Users
    come in order of falling feature count, then seq. The greedy rule is sequential, so a tenant's
    users are taken in rounds: a task has one tenant's users of the round and the clusters that the
    rounds before left in a table, and tenants run side by side. Results are those of the rule over
    all users at once. Clusters below ``min_size`` are dropped; numbers follow the first member's place."""
    if metric not in ("jaccard", "gower"):
        raise ValueError(f"unknown metric {metric}")
    schema = "tenant_id string, cluster long, user_id string, state string"

    def run(g: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if g.empty:  # a tenant whose users have all been taken
            return pd.DataFrame(columns=["tenant_id", "cluster", "user_id", "state"])
        if metric == "gower":
            for c in ("numeric", "categorical", "spread"):
                g[c] = g[c].map(lambda m: dict(m or {}))
            rule = _Gower(g["spread"].iloc[0])
            clusters = [rule.load(x) for x in before.sort_values("cluster")["state"]]
        else:
            clusters = [_Jaccard.load(x) for x in before.sort_values("cluster")["state"]]
            rule = _Jaccard(clusters)
        g = g.sort_values(["order", "seq", "user_id"], kind="stable")
        at = _greedy(g, rule, threshold, clusters)
        placed = pd.DataFrame({"tenant_id": g["tenant_id"], "cluster": at, "user_id": g["user_id"], "state": None})
        left = pd.DataFrame({"tenant_id": g["tenant_id"].iloc[0], "cluster": range(len(clusters)), "user_id": None, "state": [rule.dump(c) for c in clusters]})
        return pd.concat([placed, left])

    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    d = users.select("tenant_id", "user_id", "behaviors", "pages", "seq", *(["numeric", "categorical"] if metric == "gower" else []))
    d = d.withColumn("order", -(size("behaviors") + held("numeric") + held("categorical") if metric == "gower" else size("behaviors")))
    d = _in_rounds(d)
    if metric == "gower":
        spread = d.select("tenant_id", F.explode("numeric").alias("k", "v")).groupBy("tenant_id", "k").agg((F.max("v") - F.min("v")).alias("v"))
        spread = spread.groupBy(F.col("tenant_id").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("spread"))
        d = d.join(spread, F.col("tenant_id").eqNullSafe(F.col("t")), "left").drop("t")
    d = kept(d)
    rounds = d.agg(F.max("round")).first()[0]
    state = users.sparkSession.createDataFrame([], schema)
    parts = [state]
    for i in range((rounds or 0) + 1):
        done = d.where(F.col("round") == i).groupBy("tenant_id").cogroup(state.groupBy("tenant_id")).applyInPandas(run, schema)
        done = kept(done)
        state = done.where("state is not null")
        parts.append(done.where("state is null"))
    placed = functools.reduce(DataFrame.unionByName, parts).drop("state")
    large = placed.groupBy(F.col("tenant_id").alias("t"), F.col("cluster").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return placed.join(large, F.col("tenant_id").eqNullSafe(F.col("t")) & (F.col("cluster") == F.col("c")), "left_semi")


def cluster_id(members: Column) -> Column:
    """A name that depends on the members alone."""
    return F.concat(F.lit("clust_"), F.substring(F.sha2(F.array_join(F.array_sort(members), "|"), 256), 1, 16))
