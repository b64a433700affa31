"""Continuous metric ingestion with Structured Streaming, an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import FIELDS, RECORD


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Metric records as JSON lines that arrive in a folder; a malformed line stops the stream."""
    return spark.readStream.schema(RECORD).option("mode", "FAILFAST").json(folder)


def windowed_totals(records: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Totals of each task and arm in event-time windows; records later than the watermark are not counted."""
    timed = records.withColumn("at", F.to_timestamp("recorded_at")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "task_id", "arm").agg(F.count("*").alias("record_count"), *[F.sum(f).alias(f) for f in FIELDS])
