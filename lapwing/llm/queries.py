"""The registered queries of this subpackage: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontamination, html_extract, jaccard_join, lm_scoring, packing, piece_encoding, quality_classifier, quality_rules, secret_scan, token_alignment, warc, whitening
from .frames import table
from .suffix_dedup import repeated_bytes


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"), threshold=400)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), trusted)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components_of(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("did", "rid")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.fit_and_scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"))


def op13_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode(table(spark, sf_dir, "documents"))


#: of equal payloads the smallest page is the response; base 32 takes 5 bits at a time from 5 hexadecimal digits
OP8_SQL = """
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), f AS (SELECT hex, min(page_id) AS first_id FROM p GROUP BY hex)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(p.hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (hex)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_decontamination": op6_decontamination,
        "op7_html_extraction": op7_html_extraction,
        "op8_warc": op8_warc,
        "op9_secret_scan": op9_secret_scan,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_whitening": op11_whitening,
        "op12_token_alignment": op12_token_alignment,
        "op13_piece_encoding": op13_piece_encoding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": OP8_SQL}
