"""Inputs of the named queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest, text
from ..operators import catalog, scoring
from ..sources.tables import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a catalog row: path, authority, modules, topics, title, hash and content."""
    names = F.array(*[F.lit(a) for a in catalog.AUTHORITIES])
    docs = table(spark, sf_dir, "documents").withColumn("content", F.coalesce("text", F.lit("")))
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("-"), F.col("doc_id"), F.lit(".md"))
    rows = docs.select(
        "doc_id",
        path.alias("path"),
        F.substring(F.get(F.split("content", "\n"), F.lit(0)), 1, 60).alias("title"),
        F.get(names, (F.col("doc_id") % len(catalog.AUTHORITIES)).cast("int")).alias("authority"),
        F.array("lang").alias("modules"),
        F.array("source").alias("topics"),
        digest.text_hash(F.col("content")).alias("source_hash"),
        F.octet_length("content").cast("long").alias("size_bytes"),
        "content",
    )
    return rows.withColumn("id", digest.document_id(F.col("path")))


#: DuckDB twin of corpus().
CORPUS = """
corpus AS (
  SELECT *, 'DOC-' || sha256(path) AS id FROM (
    SELECT doc_id, 'docs/' || lang || '/' || source || '-' || doc_id || '.md' AS path, left(split_part(coalesce(text, ''), chr(10), 1), 60) AS title,
      (['policy','adr','specification','contract_schema','roadmap','implementation_note','generated_summary'])[CAST(doc_id % 7 AS INT) + 1] AS authority,
      CAST(doc_id % 7 AS INT) AS authority_rank, lang, source, 'sha256:' || sha256(coalesce(text, '')) AS source_hash,
      CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes, coalesce(text, '') AS content
    FROM documents)
)"""
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def tasks(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Fixed tasks over the corpus."""
    rows = rows or [
        ("T-1", "Find what the other reports say", "the other that", [("AC-001", "they are there", ["there", "other"]), ("AC-002", "reads and writes the index", None)], ["docs/en/src1-1.md"], ["thing"], [], ["docs/en/src2-2.md"], 8, 60_000, 15_000),
        ("T-2", "Security audit of tokens", "de la para", [("AC-001", "la que los para", None)], [], [], ["para"], [], 4, 20_000, 5_000),
        ("T-3", "Prüfen", "und der die", [("AC-001", "der und", ["der", "und", "von"])], ["docs/de"], [], [], [], 6, 9_000, 2_250),
    ]
    return spark.createDataFrame(rows, scoring.TASKS)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a candidate of the task whose number it falls to."""
    rows = corpus(spark, sf_dir)
    evidence = F.when(F.col("authority") == "policy", "convention:root-agents-file").when(F.col("authority") == "adr", "docs-adr").when(F.col("authority") == "specification", "docs-specification").when(F.col("authority") == "contract_schema", "docs-contract-schema").when(F.col("authority") == "roadmap", "docs-roadmap")
    none = F.lit(None)
    return rows.select(
        F.concat(F.lit("T-"), F.col("doc_id") % 3 + 1).alias("task_id"), "id", F.lit("document").alias("kind"), F.lit("documents").alias("provider"), "path",
        none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), F.when(F.col("doc_id") % 50 == 7, F.concat(F.lit("sym"), F.col("doc_id") % 200)).alias("symbol"),
        "source_hash", F.col("source_hash").alias("excerpt_hash"), F.when(F.col("doc_id") % 2 == 0, "live").otherwise("snapshot").alias("freshness"), "authority",
        F.array_compact(F.array(evidence)).alias("authority_evidence"), F.col("content").alias("excerpt"), F.col("size_bytes").alias("excerpt_bytes"), text.token_estimate(F.col("content")).alias("estimated_tokens"),
        none.cast("int").alias("graph_distance"), F.array().cast("array<string>").alias("matched_terms"), F.array().cast("array<string>").alias("criteria_ids"), F.lit(False).alias("truncated"), F.array().cast("array<string>").alias("truncation_reasons"),
    )
