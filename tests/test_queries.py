"""Every query of the registry against its SQL twin, or at least run."""

import duckdb
import pandas as pd
import pytest

from tessella import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return "null"
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    got = registry.queries()[name](spark, small).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without an SQL twin, which other tests compare with plain versions.
PLAIN = {"segment_jaccard", "segment_gower", "style_coherent_samples", "suite_behavioral", "grounded_claims", "answer_shift", "html_messages", "bronze_flat_records", "page_threads", "tournament_strengths", "tfidf_layout", "verbatim_samples", "segment_summaries", "ks_against_normal", "spine_ablation", "removal_ranking"}


def test_queries_without_sql_have_a_plain_version():
    assert set(registry.queries()) - set(registry.oracle_sql()) <= PLAIN


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
