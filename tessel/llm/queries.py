"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import audit, decontam, divergence, neardup, quality
from tessel.llm.langid import identify
from tessel.llm.packing import packing_digest
from tessel.llm.pii import find_pii
from tessel.llm.secrets import scan_secrets
from tessel.llm.sharding import sharding_digest
from tessel.llm.substring import repeats_digest
from tessel.llm.tokenfile import token_file_digest
from tessel.llm.wrappers import extract_pages


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(_docs(spark, sf_dir))


def op2_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_docs(spark, sf_dir))


def op3_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_docs(spark, sf_dir))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_docs(spark, sf_dir))


def op5_bit_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_docs(spark, sf_dir))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.near_duplicates(_docs(spark, sf_dir), n=2)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding_digest(_docs(spark, sf_dir))


def op8_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(_docs(spark, sf_dir))


def op10_recurrent_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir))


def op11_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_lattice_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_tiled_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing,
        op2_quality_cascade,
        op3_secret_novelty,
        op4_weak_supervision_pii,
        op5_bit_packed_token_files,
        op6_circulant_minhash,
        op7_balanced_label_propagation,
        op8_containment_decontamination,
        op9_suffix_array_dedup,
        op10_recurrent_language_id,
        op11_wrapper_induction,
        op12_lattice_filter_audit,
        op13_tiled_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_cascade": quality.ORACLE_SQL,
    "op6_circulant_minhash": neardup.ORACLE_SQL,
    "op8_containment_decontamination": decontam.ORACLE_SQL,
    "op12_lattice_filter_audit": audit.ORACLE_SQL,
    "op13_tiled_source_divergence": divergence.ORACLE_SQL,
}
