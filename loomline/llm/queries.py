"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_graph, decontaminate, filter_audit, hard_negatives, langid, line_dedup, mixing, near_dedup, ngram_lm, packing, sharding, suffix_dedup, token_files
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.LIMIT)


def op3_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_graph.report(table(spark, sf_dir, "embeddings"))


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_byte_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(table(spark, sf_dir, "documents"))


def op9_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.report(table(spark, sf_dir, "documents"))


def op10_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


def op13_distance_key_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_byte_language_id, op2_extendible_sharding, op3_pruned_graph_search, op4_hierarchical_mixing, op5_fuzzy_line_dedup, op6_induced_suffix_dedup, op7_winnowing_decontamination, op8_token_files, op9_kneser_ney_scores, op10_setsketch_near_dedup, op11_filter_interaction_audit, op12_cutting_stock_packing, op13_distance_key_negatives)}

ORACLES: dict[str, str] = {
    "op2_extendible_sharding": sharding.ORACLE,
    "op4_hierarchical_mixing": mixing.ORACLE,
    "op7_winnowing_decontamination": decontaminate.ORACLE,
    "op11_filter_interaction_audit": filter_audit.ORACLE,
    "op13_distance_key_negatives": hard_negatives.ORACLE,
}
