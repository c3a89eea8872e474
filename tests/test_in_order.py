"""Doubles are added in the order of a table's rows, as the SQL does it with one thread, however Spark deals the
rows out."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella import registry
from tessella.functions import stats


def test_sums_follow_the_order_of_the_rows(spark):
    r = random.Random(5)
    rows = [(k, i, r.random() * 10 ** r.randrange(12)) for k in range(7) for i in range(400)]
    want = dict.fromkeys(range(7), 0.0)
    for k, _, x in rows:
        want[k] += x
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "k long, i long, x double").repartition(9)
    got = {x["k"]: (x["s"], x["m"]) for x in stats.in_order(d, ["k"], ["i"]).groupBy("k").agg(F.sum("x").alias("s"), F.avg("x").alias("m")).collect()}
    assert got == {k: (s, s / 400) for k, s in want.items()}


@pytest.fixture
def many_splits(spark):
    """A task for each small row group."""
    sizes = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def differences(spark, folder, query: str, table: str, columns: dict) -> int:
    """Rows that a query gives other than its SQL over a table of row groups of 100 rows, in disorder by key."""
    t = pa.table(columns)
    pq.write_table(t.take(pa.array(np.random.default_rng(4).permutation(len(t)))), f"{folder}/{table}.parquet", row_group_size=100)
    c = duckdb.connect()
    c.execute("set threads = 1")
    want = c.execute(f"with {table} as (from read_parquet('{folder}/{table}.parquet')) from ({registry.oracle_sql()[query]}) select *").fetchdf()
    got = registry.queries()[query](spark, str(folder)).toPandas()[list(want.columns)]
    a, b = ({tuple(map(str, r)) for r in d.itertuples(index=False)} for d in (got, want))
    assert len(a) == len(b) > 0
    return len(a - b)


def test_hyper_accuracy(many_splits, tmp_path):
    """Seven of ten answers hit, where people do 0.45: the gap is a quarter, but for how doubles add up."""
    keys = np.array([30 * m + 10 * t + digit for m in range(800) for digit in range(10) for t in range(3) if (t + digit) % 3 == (1 if digit < 7 else 0)])
    columns = {"o_orderkey": keys, "o_custkey": np.arange(len(keys)) // 10 % 100, "o_orderpriority": ["1-URGENT"] * len(keys)}
    assert differences(many_splits, tmp_path, "hyper_accuracy", "orders", columns) == 0


# Below, means of 32 figures (80 prices) end half way between two whole numbers.


def test_entailment_summary(many_splits, tmp_path):
    n, r = 8000, np.random.default_rng(1)
    columns = {"l_suppkey": np.arange(n) % 250, "l_linenumber": np.arange(n) % 7, "l_returnflag": ["N"] * n, "l_quantity": r.integers(1, 51, n).astype(float)}
    assert differences(many_splits, tmp_path, "entailment_summary", "lineitem", columns) == 0


def test_featurize_numeric_mean(many_splits, tmp_path):
    n, r = 8000, np.random.default_rng(2)
    columns = {"event_id": np.arange(n), "user_id": np.arange(n) % 250, "event_type": ["click"] * n, "props": ['{"k": 1}'] * n, "value": r.integers(1, 50_000, n) / 100, "ts": pa.array(np.arange(n), pa.timestamp("us"))}
    assert differences(many_splits, tmp_path, "featurize_numeric_mean", "events", columns) == 0


def test_strategic_reasoning(many_splits, tmp_path):
    n = 8000
    columns = {"o_orderkey": np.arange(n) * 10 + 1, "o_custkey": np.arange(n) % 100, "o_totalprice": np.arange(n) * 13 // 100 % 80 * 625.0 + 50000}
    assert differences(many_splits, tmp_path, "strategic_reasoning", "orders", columns) == 0
