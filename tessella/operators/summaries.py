"""Cluster summaries: what a cluster's members did, said and are, from their records.

``members`` is (tenant_id, cluster, user_id), records are flat records. Every result has a row for
each cluster, or for each cluster and value; nothing gathers a cluster's records into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import written
from . import segment

CLUSTER = ("tenant_id", "cluster")
TOP, SAMPLE, VERBATIM = 8, 12, 8
#: Words by which a page is one of an integration.
INTEGRATION = ("api", "webhook", "integration", "github", "slack")
PREVIEW = 100


def cluster_records(records: DataFrame, members: DataFrame) -> DataFrame:
    """The records of each cluster's members; records without a user are users of their own."""
    return records.withColumn("user_id", segment.user_key()).join(members.select(*CLUSTER, "user_id"), ["tenant_id", "user_id"])


def _listed(of_cluster: DataFrame, column: str) -> DataFrame:
    d = of_cluster.select(*CLUSTER, "seq", F.posexplode(column).alias("at", "item"))
    return d.withColumn("seq", F.struct("seq", "at"))


def top_values(of_cluster: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """(cluster, item, n, rank) of the k most frequent items of a list column, first seen first."""
    return segment.top_items(_listed(of_cluster, column), list(CLUSTER), "item", k)


def summary(of_cluster: DataFrame, members: DataFrame) -> DataFrame:
    """Per cluster: cluster_size, n_records, top_behaviors and top_pages (in order), sources (their
    numbers of records), avg_session_duration (mean of users' means; null without any)."""
    ordered = lambda d, name: d.groupBy(*CLUSTER).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(name))
    size = members.groupBy(*CLUSTER).agg(F.count_distinct("user_id").alias("cluster_size"))
    by_source = of_cluster.groupBy(*CLUSTER, "source").agg(F.count("*").alias("n"))
    sources = by_source.groupBy(*CLUSTER).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"), F.sum("n").alias("n_records"))
    of_user = segment.numeric_means(segment.payload_features(of_cluster)).where("name = 'session_duration'")
    session = members.join(of_user, ["tenant_id", "user_id"]).groupBy(*CLUSTER).agg(F.avg("mean").alias("avg_session_duration"))
    out = size
    for d in (sources, ordered(top_values(of_cluster, "behaviors"), "top_behaviors"), ordered(top_values(of_cluster, "pages"), "top_pages"), session):
        out = out.join(d, list(CLUSTER), "left")
    empty = F.array().cast("array<string>")
    return out.select(
        *CLUSTER, "cluster_size", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("top_behaviors", empty).alias("top_behaviors"),
        F.coalesce("top_pages", empty).alias("top_pages"), "sources", "avg_session_duration",
    )


def typed_features(members: DataFrame, numeric: DataFrame, categorical: DataFrame, sets: DataFrame) -> DataFrame:
    """(cluster, kind, name, value, number) of a cluster's typed features: the mean over users of each
    numeric one (tenant_id, user_id, name, mean), the most frequent value of each categorical one
    (.., name, mode, seq; ties by the least seq), and a row for each value of each set (.., name, item)."""
    key, none = ["tenant_id", "user_id"], F.lit(None).cast("string")
    m = members.select(*CLUSTER, "user_id")
    averages = m.join(numeric, key).groupBy(*CLUSTER, "name").agg(F.avg("mean").alias("number"))
    voted = segment.modes(m.join(categorical, key), [*CLUSTER, "name"], "mode", out="value")
    unions = m.join(sets, key).select(*CLUSTER, "name", F.col("item").alias("value")).distinct()
    number = F.lit(None).cast("double").alias("number")
    return (
        averages.select(*CLUSTER, F.lit("average").alias("kind"), "name", none.alias("value"), "number")
        .unionByName(voted.select(*CLUSTER, F.lit("mode").alias("kind"), "name", "value", number))
        .unionByName(unions.select(*CLUSTER, F.lit("member").alias("kind"), "name", "value", number))
    )


def without_bots(of_cluster: DataFrame, *columns: str) -> DataFrame:
    """Records (all their columns, or those named) none of whose payload texts is a bot's or the system's; all
    records of a cluster that would be left without any. Texts are looked at once, for a table."""
    human = ~F.exists(F.map_values("payload"), lambda v: F.coalesce(text.is_bot(v), F.lit(False)))
    d = written(of_cluster.select(*CLUSTER, *(columns or [c for c in of_cluster.columns if c not in CLUSTER]), human.alias("__human")))
    some = d.groupBy(*CLUSTER).agg(F.max("__human").alias("__some"))
    return d.join(some, list(CLUSTER)).where("__human or not __some").drop("__human", "__some")


def representative_sample(pool: DataFrame, top: DataFrame, k: int = SAMPLE) -> DataFrame:
    """(cluster, record_id, rank): for each top behavior in turn the first record not taken that has
    it, then the first records left, k in all. ``top`` is of :func:`top_values`.

    The behavior of rank r meets at most r - 1 taken records, so its first r records settle it; a
    cluster's choice is then a fold over at most TOP * TOP ids, and the rest its first k + TOP
    records."""
    w = Window.partitionBy(*CLUSTER, "rank").orderBy("seq")
    has = pool.select(*CLUSTER, "record_id", "seq", F.explode(F.array_distinct("behaviors")).alias("item")).join(top.select(*CLUSTER, "item", "rank"), [*CLUSTER, "item"])
    first = has.withColumn("n", F.row_number().over(w)).where(F.col("n") <= TOP).where("n <= rank")
    options = first.groupBy(*CLUSTER, "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "record_id"))), lambda x: x["record_id"]).alias("ids"))
    in_turn = options.groupBy(*CLUSTER).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ids"))), lambda x: x["ids"]).alias("turns"))
    take = F.aggregate("turns", F.array().cast("array<string>"), lambda got, ids: F.concat(got, F.slice(F.filter(ids, lambda i: ~F.array_contains(got, i)), 1, 1)))
    n = F.count("*").over(Window.partitionBy(*CLUSTER))
    head = pool.select(*CLUSTER, "record_id", F.row_number().over(Window.partitionBy(*CLUSTER).orderBy("seq")).alias("at")).where(F.col("at") <= k + TOP)
    picked = in_turn.select(*CLUSTER, F.slice(take, 1, k).alias("picked"))
    d = head.withColumn("n", n).join(picked, list(CLUSTER), "left").withColumn("picked", F.when(F.col("n") <= k, F.array().cast("array<string>")).otherwise(F.coalesce("picked", F.array().cast("array<string>"))))
    rest = d.where(~F.array_contains("picked", F.col("record_id")))
    rest = rest.withColumn("rank", F.size("picked") + F.row_number().over(Window.partitionBy(*CLUSTER).orderBy("at"))).where(F.col("rank") <= k)
    small = head.groupBy(*CLUSTER).agg(F.count("*").alias("n")).where(F.col("n") <= k)  # clusters that are their own sample
    chosen = picked.join(small, list(CLUSTER), "left_anti").select(*CLUSTER, F.posexplode("picked").alias("p", "record_id"))
    return chosen.select(*CLUSTER, "record_id", (F.col("p") + 1).alias("rank")).unionByName(rest.select(*CLUSTER, "record_id", "rank"))


def enrichment(of_cluster: DataFrame) -> DataFrame:
    """(cluster, kind, value, n, rank) in the order first seen: titles, industries and the commonest
    company size of business records, topic and preview of support records, pages of integrations
    and events of web records."""
    at = lambda k: F.col("payload")[k]
    seen = ["seq", "at"]

    def rows(source: str, kind: str, values: Column) -> DataFrame:
        d = of_cluster.where(F.col("source") == source).select(*CLUSTER, F.lit(kind).alias("kind"), "seq", F.posexplode(values).alias("at", "value"))
        return d.where("value is not null and value <> ''")

    one = lambda c: F.array(c)
    preview = F.substring(F.coalesce(at("message"), F.lit("")), 1, PREVIEW)
    intent = F.when(preview != "", F.concat(F.coalesce(at("topic"), F.lit("")), F.lit(": "), preview, F.lit("..."))).otherwise(at("topic"))
    integration = F.filter("pages", lambda p: text.any_of(F.lower(p), INTEGRATION))
    listed = (
        rows("hubspot", "title", one(at("contact_title")))
        .unionByName(rows("hubspot", "company_size", one(at("company_size"))))
        .unionByName(rows("hubspot", "industry", one(at("industry"))))
        .unionByName(rows("ga4", "integration_page", integration))
        .unionByName(rows("ga4", "tech_event", F.col("behaviors")))
    )
    counted = listed.groupBy(*CLUSTER, "kind", "value").agg(F.count("*").alias("n"), F.min(F.struct(*seen)).alias("first"))
    # every support record is a signal of its own
    signals = rows("intercom", "intent", one(intent)).select(*CLUSTER, "kind", "value", F.lit(1).cast("bigint").alias("n"), F.struct(*seen).alias("first"))
    by_size = F.when(F.col("kind") == "company_size", -F.col("n")).otherwise(F.lit(0))
    order = Window.partitionBy(*CLUSTER, "kind").orderBy(by_size, "first")
    d = counted.unionByName(signals).withColumn("rank", F.row_number().over(order))
    return d.where("kind <> 'company_size' or rank = 1").drop("first")


def verbatim_candidates(of_cluster: DataFrame, least: int = 20, most: int = 2000) -> DataFrame:
    """(cluster, seq, at, t): payload texts of some length that no bot wrote, each once, where first seen."""
    d = of_cluster.select(*CLUSTER, "seq", F.posexplode(F.map_values("payload")).alias("at", "v")).select(*CLUSTER, "seq", "at", F.trim("v").alias("t"))
    # a text that comes often is looked at once
    d = d.where(F.length("t").between(least, most)).groupBy(*CLUSTER, "t").agg(F.min(F.struct("seq", "at")).alias("first"))
    return d.where(~text.is_bot(F.col("t"))).select(*CLUSTER, "first.seq", "first.at", "t")


def verbatim_samples(of_cluster: DataFrame, k: int = VERBATIM) -> DataFrame:
    """(cluster, position, t): the k candidate texts of each cluster that are nearest to the others in
    style, in the order in which they were first seen; all of them where there are no more."""
    c = verbatim_candidates(of_cluster).withColumn("place", F.struct("seq", "at"))
    c = written(c.withColumn("signature", text.style_signature(F.col("t"))))
    chosen = segment.style_coherent(c, list(CLUSTER), "place", "signature", k)
    order = Window.partitionBy(*CLUSTER).orderBy("place")  # of the k
    return c.join(chosen.select(*CLUSTER, "place"), [*CLUSTER, "place"]).select(*CLUSTER, (F.row_number().over(order) - 1).alias("position"), "t")


def segment_summaries(records: DataFrame, users: DataFrame, metric: str = "jaccard", threshold: float = 0.3, min_size: int = 2) -> DataFrame:
    """From records to summarised clusters: (cluster, cluster_id, members, ...of :func:`summary`, sample, verbatim),
    a row for each cluster of ``users`` (as :func:`segment.cluster_users` takes them)."""
    members = written(segment.cluster_users(users, metric, threshold, min_size))
    of_cluster = written(cluster_records(records, members))
    named = members.groupBy(*CLUSTER).agg(F.array_sort(F.collect_list("user_id")).alias("members"))  # the result itself
    pool = without_bots(of_cluster, "record_id", "seq", "behaviors")
    listed = lambda d, at, x, name: d.groupBy(*CLUSTER).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, x))), lambda r: r[x]).alias(name))
    sample = listed(representative_sample(pool, top_values(pool, "behaviors")), "rank", "record_id", "sample")
    said = listed(verbatim_samples(of_cluster), "position", "t", "verbatim")
    out = named.withColumn("cluster_id", segment.cluster_id(F.col("members"))).join(summary(of_cluster, members), list(CLUSTER))
    out = out.join(sample, list(CLUSTER), "left").join(said, list(CLUSTER), "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("sample", "verbatim")})


# How good a clustering is.


def centrality(users: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, user_id, similarity, n_records): how like each member's behaviors are to all of its
    cluster's (Jaccard). A member has none that its cluster hasn't, so sizes of sets say it."""
    m = members.select(*CLUSTER, "user_id").join(users.select("tenant_id", "user_id", "n_records", F.array_distinct("behaviors").alias("b")), ["tenant_id", "user_id"])
    union = m.select(*CLUSTER, F.explode("b").alias("x")).groupBy(*CLUSTER).agg(F.count_distinct("x").alias("n"))
    similarity = F.coalesce(F.size("b") / F.col("n"), F.lit(0.0))
    return m.join(union, list(CLUSTER), "left").select(*CLUSTER, "user_id", similarity.alias("similarity"), "n_records")


def cluster_quality(users: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, size, compactness): members, and their mean similarity to the cluster's behaviors."""
    return centrality(users, members).groupBy(*CLUSTER).agg(F.count("*").alias("size"), F.avg("similarity").alias("compactness"))


def clustering_report(users: DataFrame, members: DataFrame) -> DataFrame:
    """Per tenant: users, clusters, noise (users in none) and its rate, mean and deviation of sizes,
    compactness, balance (one less the deviation over the mean; 1 for one cluster, 0 for none)."""
    n = users.groupBy("tenant_id").agg(F.count_distinct("user_id").alias("users"))
    q = cluster_quality(users, members).groupBy("tenant_id").agg(
        F.count("*").alias("clusters"), F.sum("size").alias("placed"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("size_stdev"), F.avg("compactness").alias("compactness")
    )
    d = n.join(q, "tenant_id", "left").fillna(0, ["clusters", "placed"]).fillna(0.0, ["mean_size", "size_stdev", "compactness"])
    noise = F.greatest(F.lit(0), F.col("users") - F.col("placed"))
    balance = F.when(F.col("clusters") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.try_divide(F.col("size_stdev"), F.col("mean_size"))))
    return d.select("tenant_id", "users", "clusters", noise.alias("noise"), (noise / F.col("users")).alias("noise_rate"), "mean_size", "size_stdev", "compactness", balance.alias("balance"))


def sweep(users: DataFrame, thresholds: list[float], min_sizes: list[int], metric: str = "jaccard") -> DataFrame:
    """The reports of all these settings, a run of the clustering for each threshold."""
    out = None
    for t in thresholds:
        whole = segment.cluster_users(users, metric, t, 1)
        size = whole.groupBy(*CLUSTER).agg(F.count("*").alias("n"))
        for least in min_sizes:
            kept = whole.join(size.where(F.col("n") >= least), list(CLUSTER), "left_semi")
            r = clustering_report(users, kept).select(F.lit(t).alias("threshold"), F.lit(least).alias("min_size"), "*")
            out = r if out is None else out.unionByName(r)
    return out


def outliers(users: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, user_id, similarity): the member least like its cluster; of equal ones that with fewer
    records, then the smaller id."""
    order = F.struct("similarity", "n_records", "user_id")
    return centrality(users, members).groupBy(*CLUSTER).agg(F.min_by("user_id", order).alias("user_id"), F.min("similarity").alias("similarity"))


def run_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tenant_id, overlap) of two runs' members (tenant_id, cluster, user_id): the share of all users
    whose clusters match, each cluster of the first taking in turn the free one of the second with
    most users in common (of equal ones the first)."""
    import pandas as pd

    met = a.select("tenant_id", F.col("cluster").alias("ca"), "user_id").join(b.select("tenant_id", F.col("cluster").alias("cb"), "user_id"), ["tenant_id", "user_id"])
    counts = met.groupBy("tenant_id", "ca", "cb").agg(F.count("*").alias("n"))
    total = a.select("tenant_id", "user_id").union(b.select("tenant_id", "user_id")).distinct().groupBy("tenant_id").agg(F.count("*").alias("total"))

    def matched(g: pd.DataFrame) -> pd.DataFrame:  # a tenant's pairs of clusters
        used, agree = set(), 0
        for _, own in g.sort_values(["ca", "n", "cb"], ascending=[True, False, True]).groupby("ca", sort=True):
            free = own[~own["cb"].isin(used)]
            if len(free):
                used.add(free["cb"].iloc[0])
                agree += int(free["n"].iloc[0])
        return pd.DataFrame({"tenant_id": [g["tenant_id"].iloc[0]], "agree": [agree]})

    m = counts.groupBy("tenant_id").applyInPandas(matched, "tenant_id string, agree bigint")
    return total.join(m, "tenant_id", "left").select("tenant_id", (F.coalesce("agree", F.lit(0)) / F.col("total")).alias("overlap"))


def sample_coverage(records: DataFrame, samples: DataFrame, more: DataFrame) -> DataFrame:
    """(sampled, records, behaviors): the shares of all records and of all behaviors that the sampled
    record ids reach, without and with those of ``more``."""
    all_of = records.agg(F.count_distinct("record_id").alias("r"))
    kinds = records.select(F.explode("behaviors").alias("b")).agg(F.count_distinct("b").alias("b"))
    both = {"base": samples.select("record_id"), "with more": samples.select("record_id").union(more.select("record_id"))}
    out = None
    for name, ids in both.items():
        hit = records.join(ids.distinct(), "record_id", "left_semi")
        d = hit.agg(F.count_distinct("record_id").alias("nr")).join(hit.select(F.explode("behaviors").alias("x")).agg(F.count_distinct("x").alias("nb")), F.lit(True))
        d = d.join(all_of, F.lit(True)).join(kinds, F.lit(True)).select(F.lit(name).alias("sampled"), (F.col("nr") / F.col("r")).alias("records"), (F.col("nb") / F.col("b")).alias("behaviors"))
        out = d if out is None else out.unionByName(d)
    return out
