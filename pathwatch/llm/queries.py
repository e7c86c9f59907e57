"""The registered queries of this subpackage and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from .common import table
from .decomposition import decompose
from .decontamination import find_leaks
from .embedding_dedup import near_duplicate_vectors
from .license_scan import scan_licenses
from .minhash_dedup import near_duplicates
from .orc_tokens import tokenize_to_orc
from .packing import pack_sequences
from .quality import score_quality
from .resampling import resample
from .sharding import shard
from .spelling import spelling_variants
from .substring_dedup import dedup_substrings
from .toxicity import score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), limit=1 << 20)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_orc(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), typo=31)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality": op4_quality,
    "op5_sharding": op5_sharding,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_orc_tokens": op7_orc_tokens,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_power_of_two_packing": op13_power_of_two_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op5_sharding": oracle.SHARDING,
    "op10_license_scan": oracle.LICENSE_SCAN,
    "op11_spelling_variants": oracle.SPELLING_VARIANTS,
    "op12_importance_resampling": oracle.IMPORTANCE_RESAMPLING,
}
