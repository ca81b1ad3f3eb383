"""The corpus pipeline: language ID, exact dedup, MinHash near-dedup, secret scans, packing.

Each stage takes rows, not ids: rows that repeat an id, and rows without one, are documents of their own.

Defined results: a null or empty text has no letters, so the language stage rejects it (the later stages
alone take it as an empty text: exact keeps one of them, near links it with nothing, secrets leaves it, and it
packs as its closing id); where no row has a label the language stage keeps all; of equal texts the
one with most code points, then the smallest id, stays, and of a near group the smallest id; repeated rows
leave one; texts are read whole; other columns, whatever their names, pass through all stages but the last; an
empty table stays empty.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pacelake.llm import exact_dedup, language_id, minhash_dedup, packing, secret_scan
from pacelake.llm.common import Scratch, without_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus knows; what has no letters or is like no language goes."""
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_rows(docs, exact_dedup.exact_dedup, Scratch(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return without_rows(docs, partial(minhash_dedup.near_dedup, own_ids=True), Scratch(spark, "near"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training windows, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("secrets", secrets), ("packed", packed)]

#: No SQL can say what the language, near-duplicate and packing stages do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(*(n for n, _ in STAGES if n != name))
    return STAGES[-1][1](spark, docs, sf_dir)
