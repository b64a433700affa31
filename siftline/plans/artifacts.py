"""Stored packages and record files: written whole, read back only if they hold.

Paths are any that Spark's file systems reach. A package is one JSON file; it is written
beside its place and renamed, so a reader never sees half of it. Records are JSON lines in
one file for each append; a file is validated with all before it is added.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import json_hash
from ..operators import ledger
from ..operators.requests import RequestError
from . import api

MAX_ARTIFACT_BYTES, MAX_INPUT_BYTES, MAX_DEPTH, MAX_VALUES = 8 << 20, 1 << 20, 64, 100_000
KEPT = ("request", "envelope", "receipt")


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """One whole file, put in place by one rename that replaces an existing one, so a reader finds the old or the new."""
    if len(body.encode()) > MAX_ARTIFACT_BYTES:
        raise RequestError("artifact is too large")
    files, place = _place(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    full = files.makeQualified(beside)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(full, files.makeQualified(place), over)


def read_json(spark: SparkSession, path: str, max_bytes: int = MAX_ARTIFACT_BYTES) -> Any:
    """The value of one JSON file: at most so many bytes, valid UTF-8, no repeated keys, no numbers that are not finite, bounded depth."""
    files, place = _place(spark, path)
    if not files.exists(place):
        raise RequestError("artifact is missing")
    if files.getFileStatus(place).getLen() > max_bytes:
        raise RequestError("artifact is too large")
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return parse_json(bytes(row["content"]))


def parse_json(data: bytes) -> Any:
    """A JSON value that breaks none of the rules for stored values."""

    def pairs(found: list[tuple[str, Any]]) -> dict[str, Any]:
        if len({k for k, _ in found}) < len(found):
            raise RequestError("a key is repeated")
        if any(k in ("__proto__", "constructor", "prototype") for k, _ in found):
            raise RequestError("a key is reserved")
        return dict(found)

    def refuse(name: str) -> None:
        raise RequestError(f"{name} is not a JSON number")

    try:
        value = json.loads(data.decode("utf-8"), object_pairs_hook=pairs, parse_constant=refuse)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as error:
        raise RequestError("artifact is no JSON") from error
    level, depth, values = [value], 0, 0
    while level:
        depth, values = depth + 1, values + len(level)
        if depth > MAX_DEPTH:
            raise RequestError("artifact is too deep")
        if values > MAX_VALUES:
            raise RequestError("artifact has too many values")
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
    return value


def write_package(spark: SparkSession, folder: str, package: dict[str, Any]) -> str:
    """Store request, envelope and receipt of a package; its path, named by task and selection."""
    errors = api.verify(package)
    if errors:
        raise RequestError("; ".join(errors))
    envelope = package["envelope"]
    path = f"{folder.rstrip('/')}/{envelope['task_id']}/{envelope['selection_digest'].split(':')[1]}.json"
    body = {k: package[k] for k in KEPT if k in package}
    write_text(spark, path, json.dumps(body | {"package_digest": json_hash(body)}, ensure_ascii=False, indent=2) + "\n")
    return path


def read_package(spark: SparkSession, path: str) -> dict[str, Any]:
    """A stored package whose digests and links all hold."""
    value = read_json(spark, path)
    if not isinstance(value, dict) or set(value) - {"package_digest", *KEPT} or not {"envelope", "receipt"} <= set(value):
        raise RequestError("not a package")
    body = {k: v for k, v in value.items() if k != "package_digest"}
    errors = api.verify(body) + ([] if json_hash(body) == value.get("package_digest") else ["package digest"])
    if "request" in body and json_hash(body["request"]) != body["envelope"]["request_digest"]:
        errors.append("request is of another selection")
    if errors:
        raise RequestError("; ".join(errors))
    return body


def compact(package: dict[str, Any]) -> dict[str, Any]:
    """What a caller needs of a package: items without texts, what is missing, and how many decisions there are of each status."""
    envelope, statuses = package["envelope"], [d["status"] for d in package["receipt"]["decisions"]]
    keys = ("id", "path", "kind", "authority", "line_start", "line_end", "symbol", "selection_reason", "estimated_tokens")
    return {
        "task_id": envelope["task_id"], "selection_digest": envelope["selection_digest"], "evidence_status": envelope["evidence_status"], "budget_status": envelope["budget_status"],
        "items": [{k: i[k] for k in keys if i.get(k) is not None} for i in envelope["items"]],
        "decision_counts": {s: statuses.count(s) for s in sorted(set(statuses))}, "remaining_evidence": api.remaining_evidence(envelope),
    }


def append_records(spark: SparkSession, folder: str, records: list[dict[str, Any]]) -> DataFrame:
    """Add records (task_id, sequence, body) to a ledger folder and return the whole chained ledger; nothing is written unless all of it holds."""
    files, place = _place(spark, folder)
    shape = "task_id string, sequence long, body string, record_digest string, previous_record_digest string"
    old = spark.read.schema(shape).json(folder) if files.exists(place) else spark.createDataFrame([], shape)
    new = spark.createDataFrame([(r["task_id"], r["sequence"], r["body"]) for r in records], "task_id string, sequence long, body string")
    whole = ledger.chain(old.select("task_id", "sequence", "body").unionByName(new))
    kept = old.select("task_id", "sequence", F.col("record_digest").alias("r"), F.col("previous_record_digest").alias("p"))
    changed = whole.join(kept, ["task_id", "sequence"]).where(~F.col("r").eqNullSafe(F.col("record_digest")) | ~F.col("p").eqNullSafe(F.col("previous_record_digest")))
    wrong = [r.asDict() for r in ledger.chain_violations(whole).limit(5).collect()] + [r.asDict() for r in changed.select("task_id", "sequence").limit(5).collect()]
    if wrong:
        raise RequestError(f"ledger does not hold: {wrong}")
    rows = whole.join(new.select("task_id", "sequence"), ["task_id", "sequence"], "left_semi").select(*[c.split()[0] for c in shape.split(", ")])
    lines = "".join(json.dumps(r.asDict(), ensure_ascii=False) + "\n" for r in rows.orderBy("task_id", "sequence").collect())
    write_text(spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.jsonl", lines)
    return spark.read.schema(shape).json(folder)


def expanded(spark: SparkSession, package: dict[str, Any], of: dict[str, Any], asked: dict[str, Any], candidates: DataFrame, known: dict[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """expand() that answers a request it has seen before (by digest, in known) with the same result."""
    key = json_hash({"selection_digest": package["envelope"]["selection_digest"], "request": asked})
    if key not in known:
        known[key] = api.expand(spark, package, of, asked, candidates)
    return known[key]


def replayed(spark: SparkSession, package: dict[str, Any], root: str, expansions: list[dict[str, Any]] | None = None) -> dict[str, Any]:
    """Compile a stored package's request again on the repository as it is now, apply its expansions again, and compare."""
    seen = api.observe(spark, root)
    of = package["request"] | {"snapshot": seen["snapshot"]}
    pool = api.gather(api.task_row(spark, of), seen)
    now = api.compile_task(spark, of, pool)
    for asked in expansions or []:
        now, _ = api.expand(spark, now, of, asked | {"previous_selection_digest": now["envelope"]["selection_digest"], "known_candidate_ids": [i["id"] for i in now["envelope"]["items"]]}, pool)
    return api.replay(package, now)
