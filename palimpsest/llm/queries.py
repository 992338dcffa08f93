"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bm25, bpe, common, exactdedup, langid, licenses, lm, packing, simhash, tokenfile, toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(common.read(spark, sf_dir, "documents"))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.every_fiftieth(common.read(spark, sf_dir, "documents"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out(common.read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.groups(common.read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_language_id, op2_bm25_search, op3_bpe_round_trip, op4_toxicity, op5_license_scan, op6_token_files, op7_lm_score, op8_best_fit_packing,
        op9_exact_dedup, op10_simhash,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": exactdedup.ORACLE}
