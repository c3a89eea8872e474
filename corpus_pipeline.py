"""From documents to packed training windows: five stages, each a table that the next one reads.

Every stage takes any columns beside those of documents and gives those of documents alone (the last
one its pieces). Null ids, repeated rows and whole texts of any length are rows like others; an
empty table gives an empty one. run() applies them in order and returns the last one's rows. No stage can be said in SQL (they
learn, hash and form components), so ORACLE_SQL is None and the tests compare the pipeline with a
brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import language_id, line_dedup, packing, secret_scan, simhash
from tessella.llm.common import discard, materialize, scratch_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in COLUMNS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence; lang becomes the predicted one. Learned
    from the labels that ``docs`` has. Nulls, empty texts and texts without letters go; where no
    row has a label, nothing is known and all go. Repeated rows stay or go together; a text as near
    to two languages has the first by name."""
    model = language_id.fit(docs, F.lit(True))
    kept = language_id.identify(docs, model).where(~F.col("rejected"))
    return _documents(kept.withColumn("lang", F.col("lang_pred")))


def deduplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the first line of each component of like lines only: the first by id (null
    first), text and place. Rows that agree in id and text lose the same lines; a document may lose
    all of them and stays, empty."""
    return _documents(line_dedup.dedup_lines(docs))


def deduplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id, of those the one with the
    smallest hash of its text; a row without a doc_id only where no row of the component has one.
    Rows that agree in both are one as well. Documents that lost all their lines are alike, so one
    of them stays at most."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash.simhash_components(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "__row")
    first = found.join(rows.select("__row", "doc_id", "text"), "__row").groupBy("component_id").agg(F.min_by("__row", order).alias("__row"))
    return _documents(rows.join(first.select("__row"), "__row", "left_semi"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret replaced by the kind it is of; the rest of a text stays as it is, and
    repeated rows stay repeated."""
    return _documents(secret_scan.mask_secrets(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in windows of 1024 tokens. Null and empty texts are an end id
    alone; rows without an id and repeated rows have pieces of their own."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", deduplicate_lines),
    ("simhash_near_dedup", deduplicate_documents),
    ("secret_scan", mask_secrets),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = None
    for name, stage in STAGES[:-1]:
        with scratch_scope() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(*([made] if made is not None else []))
        made = docs
    pieces = STAGES[-1][1](spark, docs, sf_dir)  # cut into a table of its own, so that docs can go
    discard(made)
    return pieces
