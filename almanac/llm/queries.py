"""The queries of the operators of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents")).select(
        "doc_id", "piece", F.col("start").cast("long"), F.col("length").cast("long"), "ids_crc32", "sequence_id", "offset"
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded

    return encoded(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngrams import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(read(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


OP8 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_license_scans": op7_license_scans,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_media_columns": op10_media_columns,
}
SQL: dict[str, str] = {"op8_exact_dedup": OP8}
