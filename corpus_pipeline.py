"""Corpus cleaning pipeline: each stage reads what its predecessor wrote as Parquet.

Defined results of every stage but the last: the columns of its input, whatever their names;
no rows for no rows. A null text is an empty one: it is never toxic or contaminated, all
empty texts are one class of near-copies, and it stays null where nothing is masked. A null
id is a row like any other. Rows that repeat share their score, their hits and their masks;
the near-copy stage keeps one of them. Ties between copies go to the least id, then the
least hash of the text. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, near_copies, packing, pii, toxicity
from siftline.sources.scratch import stored
from siftline.sources.tables import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier scores as toxic."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: 0.8 or more of the five-word shingles of two are shared."""
    return near_copies.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that repeat benchmark passages."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of the kept documents into training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii_masking),
    ("packing", harmonic_packing),
]

#: Training a classifier is not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
