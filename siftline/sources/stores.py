"""Stores that an append only touches where its keys lie: hash-chained ledgers and keyed values.

Rows are dealt into ``BUCKETS`` by a hash of their task or key. A version's manifest says
which folders each bucket consists of, so an append reads the buckets of its own keys, adds
a folder of new rows and replaces the small tail table of these buckets; older records are
not read. Commits are those of ``versions``: whole or not at all, and of two appends to one
version the second is tried again on top of the first.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest
from ..sources.scratch import cut
from . import versions

BUCKETS = 256
MAX_FOLDERS = 32
TRIES = 8
MAX_OUTCOMES = 1_024
Result = TypeVar("Result")


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _retried(attempt: Callable[[], Result]) -> Result:
    for k in range(TRIES):
        try:
            return attempt()
        except versions.Conflict:
            if k == TRIES - 1:
                raise
    raise AssertionError


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # BUCKETS rows at most


def _of_buckets(spark: SparkSession, base: versions.Version | None, kind: str, buckets: list[int], schema: str) -> DataFrame:
    """The rows that a version has of one kind in some buckets."""
    folders = [f"{base.root}/{p}" for b in buckets for p in base.tables.get(f"{kind}-{b}", [])] if base else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


VALUES = "key string, value string"


def insert_if_absent(rows: DataFrame, root: str) -> DataFrame:
    """key, value and inserted of every distinct key of rows (key, value): the value that the store has now, and whether this call put it there.

    Of several values of one key in rows the least counts. A key keeps its first value for
    good, whoever asks again and whatever with.
    """
    spark = rows.sparkSession
    new = cut(rows.groupBy("key").agg(F.min("value").alias("value")).withColumn("bucket", bucket(F.col("key"))))
    buckets = _touched(new)

    def attempt() -> DataFrame:
        base = versions.current(spark, root)
        old = cut(_of_buckets(spark, base, "values", buckets, VALUES).join(new.select("key"), "key", "left_semi"))
        fresh = new.join(old, "key", "left_anti")
        changed = _touched(fresh)
        if changed:
            known = base.tables if base else {}
            crowded = [b for b in changed if len(known.get(f"values-{b}", [])) >= MAX_FOLDERS]
            whole = _of_buckets(spark, base, "values", crowded, VALUES).withColumn("bucket", bucket(F.col("key")))

            def compose(stage: str) -> dict[str, list[str]]:
                return known | {f"values-{b}": [*([] if b in crowded else known.get(f"values-{b}", [])), f"{stage}/values/bucket={b}"] for b in changed}

            versions.publish(spark, root, {"values": fresh.select("key", "value", "bucket").unionByName(whole)}, base=base or _nothing(root), compose=compose, partition_by="bucket")
        return old.select("key", "value", F.lit(False).alias("inserted")).unionByName(fresh.select("key", "value", F.lit(True).alias("inserted")))

    return _retried(attempt)


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """key and value of those keys that the store has; only their buckets are read."""
    spark = keys.sparkSession
    asked = keys.select("key", bucket(F.col("key")).alias("bucket")).distinct()
    return _of_buckets(spark, versions.current(spark, root), "values", _touched(asked), VALUES).join(asked.select("key"), "key", "left_semi")


def _nothing(root: str) -> versions.Version:
    return versions.Version(root.rstrip("/"), 0, {})


RECORDS = "task_id string, sequence long, previous_record_digest string, receipt string, record_digest string, selection_digest string, run_id string"
TAILS = "task_id string, sequence long, digest string"
RUNS = "task_id string, selection_digest string, run_id string"


def record_digest(sequence: Column, previous: Column, receipt: Column) -> Column:
    """Digest of a ledger record, whose canonical JSON has the receipt's as a part."""
    before = F.when(previous.isNotNull(), F.concat(F.lit('"previous_record_digest":"'), previous, F.lit('",'))).otherwise("")
    return digest.text_hash(F.concat(F.lit("{"), before, F.lit('"receipt":'), receipt, F.lit(',"schema_version":"0.3","sequence":'), sequence.cast("string"), F.lit("}")))


def legacy_prefix(digests: Column) -> Column:
    """What the first chained record follows where a ledger begins with receipts from before there were chains: the digest of their digests in order."""
    return digest.text_hash(F.concat(F.lit('{"legacy_outcome_digests":'), F.to_json(digests), F.lit(',"schema_version":"0.3"}')))


def append_outcomes(new: DataFrame, root: str, max_records: int = MAX_OUTCOMES) -> DataFrame:
    """Add receipts (task_id, position, receipt as canonical JSON, selection_digest, run_id) to their tasks' ledgers; the records as added.

    Each record continues its task's chain at the tail that is stored beside the ledger.
    Refused as a whole: a run that a task has for a selection already, or twice among the
    new ones, and a ledger that would pass ``max_records``. Receipts without a chain
    (``chained`` false, with their ``outcome_digest``) may only begin a ledger.
    """
    spark = new.sparkSession
    for name, default in (("chained", F.lit(True)), ("outcome_digest", F.lit(None).cast("string"))):
        if name not in new.columns:
            new = new.withColumn(name, default)
    new = cut(new.withColumn("bucket", bucket(F.col("task_id"))))
    buckets = _touched(new)

    def attempt() -> DataFrame:
        base = versions.current(spark, root)
        tails = cut(_of_buckets(spark, base, "tails", buckets, TAILS))
        runs = _of_buckets(spark, base, "runs", buckets, RUNS)
        again = new.groupBy(*_names(RUNS)).agg(F.count("*").alias("n")).join(runs.withColumn("known", F.lit(True)), _names(RUNS), "left").where("n > 1 OR known")
        entry = F.struct("position", "receipt", "selection_digest", "run_id", "chained", "outcome_digest")
        tasks = new.groupBy("task_id", "bucket").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # max_records a task, checked below
        tasks = tasks.join(tails.select("task_id", F.col("sequence").alias("at"), F.col("digest").alias("tail")), "task_id", "left").withColumn("at", F.coalesce("at", F.lit(0)))
        legacy = F.filter("entries", lambda e: ~e["chained"])
        late = (F.size(legacy) > 0) & ((F.col("at") > 0) | F.exists(F.slice("entries", 1, F.size(legacy)), lambda e: e["chained"]))
        wrong = tasks.select("task_id", F.explode(F.array_compact(F.array(F.when(late, "legacy_prefix"), F.when(F.col("at") + F.size("entries") > max_records, "capacity")))).alias("rule"))
        versions._reject(wrong.unionByName(again.select("task_id", F.lit("repeated_run").alias("rule"))), "ledger does not hold")
        start = F.when(F.size(legacy) > 0, legacy_prefix(F.transform(legacy, lambda e: e["outcome_digest"]))).otherwise(F.col("tail"))
        chained = F.filter("entries", lambda e: e["chained"])
        first = F.col("at") + F.size(legacy)
        none = F.lit(None).cast("string")

        def record(sequence: Column, previous: Column, own: Column, e: Column) -> Column:
            return F.struct(sequence.alias("sequence"), previous.alias("previous_record_digest"), e["receipt"].alias("receipt"), own.alias("record_digest"), e["selection_digest"].alias("selection_digest"), e["run_id"].alias("run_id"))

        unchained = F.transform(legacy, lambda e, k: record((F.col("at") + k + 1).cast("long"), none, none, e))
        empty = F.struct(F.slice(unchained, 1, 0).alias("out"), F.col("start").alias("last"), F.col("first").cast("long").alias("n"))

        def step(a: Column, e: Column) -> Column:
            own = record_digest(a["n"] + 1, a["last"], e["receipt"])
            return F.struct(F.concat(a["out"], F.array(record(a["n"] + 1, a["last"], own, e))).alias("out"), own.alias("last"), (a["n"] + 1).alias("n"))

        chains = tasks.withColumns({"start": start, "first": first}).withColumn("done", F.aggregate(chained, empty, step)).withColumn("unchained", unchained)
        made = cut(chains.select("task_id", "bucket", F.col("done.last").alias("digest"), F.col("done.n").alias("sequence"), F.concat("unchained", "done.out").alias("records")))
        records = made.select("task_id", F.inline("records"), "bucket")
        known = base.tables if base else {}
        others = tails.join(made.select("task_id"), "task_id", "left_anti").withColumn("bucket", bucket(F.col("task_id")))
        crowded = [b for b in buckets if len(known.get(f"runs-{b}", [])) >= MAX_FOLDERS]
        all_runs = records.select(*_names(RUNS), "bucket").unionByName(_of_buckets(spark, base, "runs", crowded, RUNS).withColumn("bucket", bucket(F.col("task_id"))))

        def compose(stage: str) -> dict[str, list[str]]:
            out = dict(known)
            for b in buckets:
                out[f"tails-{b}"] = [f"{stage}/tails/bucket={b}"]
                out[f"runs-{b}"] = [*([] if b in crowded else known.get(f"runs-{b}", [])), f"{stage}/runs/bucket={b}"]
                out[f"records-{b}"] = [*known.get(f"records-{b}", []), f"{stage}/records/bucket={b}"]
            return out

        tables = {"records": records.select(*_names(RECORDS), "bucket"), "tails": made.select(*_names(TAILS), "bucket").unionByName(others.select(*_names(TAILS), "bucket")), "runs": all_runs}
        if buckets:
            versions.publish(spark, root, tables, base=base or _nothing(root), compose=compose, partition_by="bucket")
        return records.drop("bucket")

    return _retried(attempt)


def outcomes(spark: SparkSession, root: str, task_ids: list[str] | None = None) -> DataFrame:
    """Records of all tasks' ledgers, or of some tasks; for those only their buckets are read."""
    base = versions.current(spark, root)
    buckets = list(range(BUCKETS))
    if task_ids is not None:
        asked = spark.createDataFrame([(t,) for t in task_ids], "task_id string").select(bucket(F.col("task_id")).alias("bucket"))
        buckets = _touched(asked)
    rows = _of_buckets(spark, base, "records", buckets, RECORDS)
    return rows if task_ids is None else rows.where(F.col("task_id").isin(task_ids))
