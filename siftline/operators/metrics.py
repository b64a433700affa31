"""Run metrics: totals over present values and comparison of two arms behind gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digest import SAFE_INTEGER
from . import schema

# Fields of a metric record.
FIELDS = (
    "input_tokens", "cached_input_tokens", "output_tokens", "agent_output_tokens", "tool_calls", "file_reads", "codegraph_calls",
    "context_expansions", "duration_ms", "selected_context_tokens", "rework_count",
)
ENVIRONMENT = ("agent", "commit", "lockfile_hash", "model", "permissions", "reasoning_effort", "rubric", "runtime", "test_command", "time_limit_ms", "worktree_digest")
STATUSES = ("test_status", "review_status", "completion_status")
RECORD = (
    "schema_version string, task_id string, recorded_at string, arm string, " + ", ".join(f"{f} long" for f in FIELDS) + ", " + ", ".join(f"{s} string" for s in STATUSES)
    + ", estimated_fields array<string>, run_environment struct<" + ",".join(f"{e}:{'bigint' if e == 'time_limit_ms' else 'string'}" for e in ENVIRONMENT) + ">"
)


MAX_RECORDS = 10_000
_COUNT = {"type": "integer", "minimum": 0, "maximum": SAFE_INTEGER}
_STATUS = {"enum": ["PASS", "FAIL", "UNKNOWN"]}
#: What a metric record must be, as schema.violations checks it.
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["schema_version", "task_id", "recorded_at"],
    "properties": {
        "schema_version": {"const": "0.1"},
        "task_id": {"type": "string", "pattern": r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"},
        "recorded_at": {"type": "string", "pattern": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?Z$"},
        "arm": {"enum": ["A", "B"]},
        **dict.fromkeys(FIELDS, _COUNT),
        **dict.fromkeys(STATUSES, _STATUS),
        "estimated_fields": {"type": "array", "uniqueItems": True, "items": {"enum": list(FIELDS)}},
        "run_environment": {"type": "object", "additionalProperties": False, "properties": {e: _COUNT if e == "time_limit_ms" else {"type": "string", "minLength": 1} for e in ENVIRONMENT}},
    },
}


def scan(lines: DataFrame, max_records: int = MAX_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of JSON lines (file, line, value): what holds as records, and file, line, path and rule of all that does not.

    A line that is no record does not hide the others, even one of the same number or without one. A file of more than ``max_records``
    lines has one violation more, of rule capacity. Empty lines are none.
    """
    used = lines.where(F.trim("value") != "")
    wrong = schema.violations(used, "value", SCHEMA, ["file", "line"])
    crowded = used.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") > max_records)
    none = crowded.select("file", F.lit(None).cast("long").alias("line"), F.lit("$").alias("path"), F.lit("capacity").alias("rule"))
    good = schema.checked(used, "value", SCHEMA, ["file", "line", "value"]).where("rule IS NULL")
    return good.select("file", "line", F.from_json("value", RECORD).alias("r")).select("file", "line", "r.*"), wrong.unionByName(none)


def totals(records: DataFrame) -> DataFrame:
    """One row: number of records, the sum of each field over its present values (absent if none), all estimated fields.

    A sum beyond the safe integer range is an error.
    """
    safe = lambda f: F.when(F.sum(f) > SAFE_INTEGER, F.raise_error(F.lit(f"total of {f} is too large")).cast("long")).otherwise(F.sum(f)).alias(f)
    estimated = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("estimated_fields", F.array().cast("array<string>"))))))
    return records.agg(F.count("*").alias("record_count"), *[safe(f) for f in FIELDS], estimated.alias("estimated_fields"))


def _gate(a: str, b: str):
    failed = lambda s: F.coalesce(F.col(f"{s}.test_status") == "FAIL", F.lit(False)) | F.coalesce(F.col(f"{s}.review_status") == "FAIL", F.lit(False)) | F.coalesce(F.col(f"{s}.completion_status") == "FAIL", F.lit(False))
    passed = lambda s: F.coalesce((F.col(f"{s}.test_status") == "PASS") & (F.col(f"{s}.review_status") == "PASS"), F.lit(False))
    unknown = F.coalesce(F.col(f"{a}.completion_status") == "UNKNOWN", F.lit(False)) | F.coalesce(F.col(f"{b}.completion_status") == "UNKNOWN", F.lit(False))
    return F.when(failed(b), "FAIL").when(failed(a) | unknown, "UNKNOWN").when(passed(a) & passed(b), "PASS").otherwise("UNKNOWN")


def compare_arms(records: DataFrame) -> DataFrame:
    """One row for each task with a record of arm A and of arm B: deltas B − A, gates and interpretation."""
    fields = [c for c in records.columns if c not in ("task_id", "arm")]
    arms = records.where(F.col("arm").isin("A", "B")).groupBy("task_id")
    sides = arms.agg(*[F.first(F.when(F.col("arm") == s, F.struct(*fields)), ignorenulls=True).alias(s.lower()) for s in ("A", "B")]).where("a IS NOT NULL AND b IS NOT NULL")
    delta = {f: F.col(f"b.{f}") - F.col(f"a.{f}") for f in FIELDS}
    none = F.array().cast("array<string>")
    comparable = F.filter(F.array(*[F.when(d.isNotNull(), f) for f, d in delta.items()]), lambda x: x.isNotNull())
    named = F.array_union(F.coalesce("a.estimated_fields", none), F.coalesce("b.estimated_fields", none))
    differ = F.filter(F.array(*[F.when(~F.col(f"a.run_environment.{e}").eqNullSafe(F.col(f"b.run_environment.{e}")), e) for e in ENVIRONMENT]), lambda x: x.isNotNull())
    absent = F.col("a.run_environment").isNull() | F.col("b.run_environment").isNull()
    out = sides.select(
        "task_id", *[d.alias(f"delta_{f}") for f, d in delta.items()], F.array_sort(F.array_intersect(named, comparable)).alias("estimated_fields"),
        F.when(F.col("a.completion_status").isNull() | F.col("b.completion_status").isNull(), F.array(F.lit("completion_status"))).otherwise(none).alias("measurement_gaps"),
        F.when(F.size(comparable) == 0, "MISSING").otherwise("COMPARABLE").alias("measurement_gate"),
        F.when(absent, "MISSING").when(F.size(differ) > 0, "MISMATCH").otherwise("MATCHED").alias("environment_gate"),
        F.when(absent, F.array(F.lit("run_environment"))).otherwise(differ).alias("environment_mismatches"),
        _gate("a", "b").alias("quality_gate"),
    )
    meaning = (
        F.when(F.col("quality_gate") == "FAIL", "QUALITY_REGRESSION").when(F.col("quality_gate") != "PASS", "INSUFFICIENT_QUALITY_EVIDENCE")
        .when(F.col("environment_gate") != "MATCHED", "INSUFFICIENT_ENVIRONMENT_EVIDENCE").when(F.col("measurement_gate") == "MISSING", "INSUFFICIENT_MEASUREMENT_EVIDENCE")
        .otherwise("COMPARABLE_EVIDENCE")
    )
    return out.withColumn("interpretation", meaning)


def violations(records: DataFrame) -> DataFrame:
    """task_id and rule of records that break the contract."""
    checks = F.array(
        F.when(~F.col("arm").isin("A", "B"), "arm"),
        *[F.when((F.col(f) < 0) | (F.col(f) > SAFE_INTEGER), f"range:{f}") for f in FIELDS],
        F.when(F.exists(F.coalesce("estimated_fields", F.array().cast("array<string>")), lambda e: ~F.array_contains(F.filter(F.array(*[F.when(F.col(f).isNotNull(), f) for f in FIELDS]), lambda x: x.isNotNull()), e)), "estimated_absent"),
        F.when(~F.col("recorded_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$") | F.try_to_timestamp("recorded_at").isNull(), "recorded_at"),
    )
    return records.select("task_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"))
