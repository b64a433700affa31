"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import bpe_chunks, decontaminate, html_blocks, jacobi_whitening, media_ts, packing, period_runs, pii, preferences, simhash_gray, suffix_levels, toxicity, warc_derive


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive.derive_pages(table(spark, sf_dir, "pages"), records=True)


def op4_media_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.store_texts(table(spark, sf_dir, "documents"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_gray.near_duplicates(table(spark, sf_dir, "documents"))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_table(table(spark, sf_dir, "conversations"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op10_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(table(spark, sf_dir, "documents"))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jacobi_whitening.report(table(spark, sf_dir, "embeddings"))


def op12_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.report(table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_warc_derive": op3_warc_derive,
    "op4_media_ts": op4_media_ts,
    "op5_html_blocks": op5_html_blocks,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash_gray": op7_simhash_gray,
    "op8_preferences": op8_preferences,
    "op9_pii": op9_pii,
    "op10_suffix_levels": op10_suffix_levels,
    "op11_jacobi_whitening": op11_jacobi_whitening,
    "op12_bpe_chunks": op12_bpe_chunks,
    "op13_period_runs": op13_period_runs,
}
