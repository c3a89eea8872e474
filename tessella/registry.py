"""All queries of the engine by name, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import QUERIES, SQL, Query, claims, comparisons, dimensions, distributions, feeds, ingest, marked, research, scoring, segmentation, streams, summaries, variability  # noqa: F401


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the event stream, segmented by what they do."""
    return segmentation.segment_jaccard(spark, sf_dir)
