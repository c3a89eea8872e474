import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))
from odd_rows import ODD  # noqa: E402

COLUMNS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(c, T.StringType()) for c in ("fp", "spans", "words", "n", "h", "id", "th", "length", "next", "score", "rejected", "n_lines", "ids", "k", "x")),
    ]
)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["clash"] * 15) for i, t, lang in ODD], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
