"""The queries of this subpackage, one for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, fingerprints, language_id, line_dedup, packing, quality_classifier, quality_rules, ranked_search, secret_scan, simhash, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade (0 toxic, 1 of low quality, 2 good), p_not_toxic, p_good, kept."""
    docs = _table(spark, sf_dir, "documents")
    grades = quality_classifier.label_grades(_table(spark, sf_dir, "labels"))
    model = quality_classifier.fit(docs, grades, quality_classifier.LABEL_LEVELS)
    out = quality_classifier.classify(docs, model, good=2)
    return out.select("doc_id", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), "p_good", F.col("selected").alias("kept"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text of the lines that stay."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(_table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages")).drop("target_uri")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier, op2_fingerprints, op3_secret_scan, op4_simhash, op5_byte_bpe,
        op6_quality_rules, op7_line_dedup, op8_language_id, op9_token_counts, op10_packing,
        op11_ranked_search, op12_conversation_repair, op13_warc,
    )
    return {f.__name__: f for f in found}


#: What both engines can say alike. The others hash, tokenise, learn or form components: their tests
#: compare them with brute-force versions.
_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op11_ranked_search": f"""
        with d as (select doc_id, {_TERMS} as terms from documents),
        s as (select count(*) as n_docs, sum(len(terms)) as n_terms from d where len(terms) > 0),
        q as (select item_id, t, count(*) as times from (select item_id, unnest({_TERMS}) as t from benchmark) group by 1, 2),
        p as (select doc_id, n, t, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as t from d) group by 1, 2, 3),
        f as (select t, count(*) as df from p where t in (select t from q) group by 1),
        w as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from f, s),
        i as (
          select doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))::bigint as impact
          from p join w using (t), s
        ),
        r as (select item_id, doc_id, sum(times * impact)::bigint as score from q join i using (t) group by 1, 2)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
        from r where score > 0
        qualify rank <= 20""",
    "op13_warc": """
        with p as (
          select page_id, sha1(coalesce(html, '')) as sha, strlen(coalesce(html, '')) as payload_bytes
          from pages
        ), d as (
          select page_id, payload_bytes, translate(
            to_base(('0x' || sha[1:10])::ubigint::bigint, 32, 8) || to_base(('0x' || sha[11:20])::ubigint::bigint, 32, 8)
            || to_base(('0x' || sha[21:30])::ubigint::bigint, 32, 8) || to_base(('0x' || sha[31:40])::ubigint::bigint, 32, 8),
            '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') as payload_digest
          from p
        ), m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from d)
        select page_id, payload_bytes, payload_digest,
          case when page_id = top then 'response' else 'revisit' end as record_type,
          case when page_id <> top then top end as refers_to
        from m""",
}
