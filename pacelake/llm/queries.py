"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import best_fit, bpe, chat_format, embedding_dedup, exact_dedup, html_text, language_id, merkle, minhash_dedup, packing, secret_scan, substring_dedup, turn_repair
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_report(chat_format.with_probe(table(spark, sf_dir, "conversations")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_exact_dedup,
        op3_embedding_dedup,
        op4_minhash_dedup,
        op5_secret_scan,
        op6_chat_format,
        op7_language_id,
        op8_html_text,
        op9_substring_dedup,
        op10_byte_bpe,
        op11_best_fit,
        op12_turn_repair,
        op13_merkle_manifest,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
          count(*) OVER (PARTITION BY h) AS group_size,
          doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS kept, h AS text_sha256
        FROM n""",
    "op3_embedding_dedup": embedding_dedup.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op6_chat_format": chat_format.ORACLE,
    "op12_turn_repair": turn_repair.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
