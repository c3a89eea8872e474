"""Flat behavioral records: the base relation of the engine, and what is kept in files.

Columns: record_id, tenant_id, source, timestamp, user_id, behaviors array<string>, pages
array<string>, payload map<string,string>, seq (the order of arrival, for first-seen rules).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("tenant_id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("timestamp", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("behaviors", T.ArrayType(T.StringType())),
        T.StructField("pages", T.ArrayType(T.StringType())),
        T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
        T.StructField("schema_version", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """A Parquet table with each row's ``place``: its file's path and its number there."""
    return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A JSONL file, or all ``*.jsonl`` below a folder; blank lines are skipped, a missing path is an error."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Annotator labels as CSV with a header."""
    return spark.read.option("header", True).csv(path)


def fetch_all(*parts: DataFrame) -> DataFrame:
    """All rows of all sources, repeats kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_jsonl(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark results, one JSON file a run of {"tenants": {id: {"clusters": [..]}}}, as a row for each
    cluster: (run, tenant_id, failed, groundedness, attempts, cost_usd, judge)."""
    cluster = "struct<failed:boolean,groundedness:double,attempts:bigint,cost_usd:double,judge_score:struct<overall:double>>"
    d = spark.read.schema(f"tenants map<string,struct<clusters:array<{cluster}>>>").option("multiLine", True).json(path)
    rows = d.select(F.input_file_name().alias("run"), F.explode("tenants").alias("tenant_id", "t")).select("run", "tenant_id", F.explode("t.clusters").alias("c"))
    return rows.select("run", "tenant_id", F.coalesce("c.failed", F.lit(False)).alias("failed"), "c.groundedness", "c.attempts", "c.cost_usd", F.col("c.judge_score.overall").alias("judge"))


def _slug(x: str, empty: str) -> str:
    return "-".join(p for p in "".join(c.lower() if c.isalnum() else "-" for c in x).split("-") if p) or empty


def run_folders(bronze: DataFrame) -> DataFrame:
    """(crawl_run_id, folder): where a run's records go: platform, community and day; for a chat server
    its name, its channel (or that there are several, or none known), month, day and year.

    A run's platform, community and day are those of its first record (by seq)."""
    first = bronze.groupBy("crawl_run_id").agg(F.min_by(F.struct("platform", "community_id", "observed_at"), "seq").alias("x"))
    day = F.coalesce(F.when(F.col("x.observed_at") != "", F.substring("x.observed_at", 1, 10)), F.lit("unknown-date"))
    plain = F.concat_ws("/", F.coalesce(F.when(F.col("x.platform") != "", F.col("x.platform")), F.lit("unknown")), F.coalesce(F.when(F.col("x.community_id") != "", F.col("x.community_id")), F.lit("global")), day)
    server = (F.col("record_type") == "community") & (F.col("community_type") == "server")
    channel = (F.col("record_type") == "community") & F.col("community_type").isin("channel", "forum")
    used = F.col("record_type").isin("thread", "message", "interaction") & (F.col("community_id") != "")
    facts = bronze.groupBy("crawl_run_id").agg(
        F.min_by(F.when(server, F.struct("community_id", "community_name")), F.when(server, F.col("seq"))).alias("server"),
        F.collect_set(F.when(channel, F.struct("community_id", "community_name"))).alias("channels"),  # of one run's server
        F.collect_set(F.when(used, F.col("community_id"))).alias("used"),
    )
    d = first.join(facts, "crawl_run_id")
    slug = lambda c: F.coalesce(F.when((s := F.regexp_replace(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")) != "", s), F.lit("unknown"))
    others = F.array_except("used", F.array(F.col("server.community_id")))
    known = F.transform("channels", lambda c: c["community_id"])
    ids = F.when((F.size(others) == 0) & (F.size(known) == 1), known).otherwise(others)
    name = F.get(F.filter("channels", lambda c: c["community_id"] == F.get(ids, F.lit(0))), F.lit(0))["community_name"]
    folder = F.when(F.size(ids) == 1, F.concat(slug(F.coalesce(name, F.get(ids, F.lit(0)))), F.lit("_"), F.get(ids, F.lit(0)))).when(F.size(ids) > 1, "multi-channel").otherwise("unknown-channel")
    parts = F.split(day, "-")
    dated = F.when(F.size(parts) == 3, F.concat_ws("/", parts[1].cast("int"), parts[2].cast("int"), parts[0])).otherwise(day)
    chat = F.concat_ws("/", F.lit("discord"), slug(F.coalesce("server.community_name", "server.community_id", F.lit("discord"))), folder, dated)
    return d.select("crawl_run_id", F.when(F.col("x.platform") == "discord", chat).otherwise(plain).alias("folder"))


def write_runs(bronze: DataFrame, root: str) -> list[str]:
    """Write each crawl run's records as JSONL under its folder of :func:`run_folders`, and give the
    paths. No records at all are an error. A run is a crawl's output; there are few."""
    folders = sorted((r["folder"], r["crawl_run_id"]) for r in run_folders(bronze).collect())
    if not folders:
        raise ValueError("no records to write")
    paths = [f"{root}/{folder}/{run}.jsonl" for folder, run in folders]
    for path, (_, run) in zip(paths, folders, strict=True):
        bronze.where(F.col("crawl_run_id") == run).drop("seq").write.mode("overwrite").json(path)
    return paths


def _cursor_path(root: str, key: str) -> str:
    return f"{root}/{'__'.join(_slug(p, 'cursor') for p in key.split('/') if p.strip()) or 'cursor'}.json"


def save_cursor(spark: SparkSession, root: str, key: str, value: str, metadata: dict[str, str] | None = None) -> str:
    """Keep where the source ``key`` was read up to; one row of JSON that replaces the one before."""
    d = spark.createDataFrame([(key, value, metadata or {})], "key string, value string, metadata map<string,string>")
    d.coalesce(1).write.mode("overwrite").json(path := _cursor_path(root, key))
    return path


def load_cursor(spark: SparkSession, root: str, key: str) -> tuple[str, dict[str, str]] | None:
    """Value and metadata of a cursor; None if there is none or its value is blank."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_cursor_path(root, key))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    r = spark.read.schema("key string, value string, metadata map<string,string>").json(_cursor_path(root, key)).first()
    return (r["value"].strip(), r["metadata"] or {}) if r and (r["value"] or "").strip() else None


def record_results(results: DataFrame, path: str, suite: str) -> None:
    """Append a suite's results, by suite; :func:`load_results` reads them all."""
    results.withColumn("suite", F.lit(suite)).write.mode("append").partitionBy("suite").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def write_bronze(df: DataFrame, path: str) -> DataFrame:
    """One folder of JSONL for each record_type, and the manifest of counts, which is returned. Records
    that :func:`bronze.errors` finds fault with are an error, and nothing is written."""
    from ..operators import bronze

    wrong = bronze.errors(bronze.widen(df)).where(F.size("errors") > 0)
    if bad := wrong.select("record_type", "errors").head(1):
        raise ValueError(f"a record of type {bad[0]['record_type']} is invalid: {', '.join(bad[0]['errors'])}")
    df.write.mode("overwrite").partitionBy("record_type").json(f"{path}/records")
    manifest = df.groupBy("record_type").agg(F.count("*").alias("n"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


#: Event types by the kind of source that reports them.
SOURCE_OF_EVENT = {"click": "ga4", "view": "ga4", "signup": "hubspot", "purchase": "hubspot", "error": "intercom"}


def event_records(events: DataFrame, seq: str = "event_id") -> DataFrame:
    """The event stream as flat records, in order of ``seq``."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    source = F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_OF_EVENT.items() for x in kv)), F.col("event_type"))
    return events.select(
        F.concat(F.lit("ev_"), F.col("event_id")).alias("record_id"),
        F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"),
        source.alias("source"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("user_id").cast("string").alias("user_id"),
        F.array("event_type", F.concat("event_type", F.lit("_"), (k.cast("int") % 8).cast("string"))).alias("behaviors"),
        F.array(F.concat(F.lit("/k/"), k)).alias("pages"),
        F.create_map(F.lit("event"), F.col("event_type"), F.lit("session_duration"), F.col("value").cast("string"), F.lit("k"), k, F.lit("ref"), F.col("event_id").cast("string")).alias("payload"),
        F.lit("1.0").alias("schema_version"),
        F.col(seq).alias("seq"),
    )
