"""Queries of the training-data operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxflow.llm import collision_search, debruijn, decontaminate, fill_in_middle, kneser_ney, language_crf, line_dedup, merkle, mixing, ngram_join, quality_rules, style_tree, suffix_intervals


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_groups(_table(spark, sf_dir, "documents"), k=4, threshold="0.85")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rejected_by depends on the order of the rules, which is measured, so SQL can't give it
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.language_id(_table(spark, sf_dir, "documents"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.substring_dedup(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_intervals.suffix_array_dedup(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"), merkle.tampered_text()).drop("proof")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_language_id": op4_language_id,
        "op5_mixing_sources": op5_mixing_sources,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_line_dedup": op9_line_dedup,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op5_mixing_sources": mixing.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    }
