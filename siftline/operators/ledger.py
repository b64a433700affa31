"""Hash-chained ledgers, ablation, replay and expansion decisions as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..sources import stores
from .scoring import STRINGS, satisfied

MAX_EXPANSIONS, MAX_OUTCOMES = 8, 1_024


def chain(entries: DataFrame, key: str = "task_id", seq: str = "sequence", body: str = "body") -> DataFrame:
    """entries with record_digest, the hash of the entry's own content, and previous_record_digest, its predecessor's."""
    own = entries.withColumn("record_digest", digest.text_hash(F.concat_ws("\n", F.col(key).cast("string"), F.col(seq).cast("string"), body)))
    return own.withColumn("previous_record_digest", F.lag("record_digest").over(Window.partitionBy(key).orderBy(seq)))


def chain_violations(records: DataFrame, key: str = "task_id", seq: str = "sequence", body: str = "body", max_records: int = MAX_OUTCOMES) -> DataFrame:
    """Rows whose digest, predecessor or place is wrong, or that are one too many."""
    order = Window.partitionBy(key).orderBy(seq)
    placed = records.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("record_digest").over(order)).withColumn("first_seq", F.min(seq).over(Window.partitionBy(key)))
    expected = digest.text_hash(F.concat_ws("\n", F.col(key).cast("string"), F.col(seq).cast("string"), body))
    checks = F.array(
        F.when(F.col("record_digest") != expected, "digest"),
        F.when(~F.col("previous_record_digest").eqNullSafe(F.col("before")), "previous"),
        F.when(F.col(seq) != F.col("first_seq") + F.col("place") - 1, "sequence"),
        F.when(F.col("place") > max_records, "capacity"),
    )
    return placed.select(key, seq, F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"))


def outcome_violations(records: DataFrame, max_records: int = MAX_OUTCOMES) -> DataFrame:
    """task_id, sequence and rule of records (as ``stores.outcomes`` returns them, with ``outcome_digest`` for receipts without a chain) that break their ledger.

    Every record is checked at once: its digest is that of what it holds, it names its
    predecessor's, and only its own and its predecessor's row are needed for that.
    """
    order = Window.partitionBy("task_id").orderBy("sequence")
    every = Window.partitionBy("task_id")
    unchained = F.col("record_digest").isNull()
    legacy = F.sort_array(F.collect_list(F.when(unchained, F.struct("sequence", "outcome_digest"))).over(every))
    placed = records.withColumns({
        "place": F.row_number().over(order),
        "before": F.lag("record_digest").over(order),
        "n_legacy": F.count_if(unchained).over(every),
        "same_run": F.row_number().over(Window.partitionBy("task_id", "selection_digest", "run_id").orderBy("sequence")),
        "prefix": stores.legacy_prefix(F.transform(legacy, lambda x: x["outcome_digest"])),
    })
    follows = F.when((F.col("place") == F.col("n_legacy") + 1) & (F.col("n_legacy") > 0), F.col("prefix")).otherwise(F.col("before"))
    own = stores.record_digest(F.col("sequence"), F.col("previous_record_digest"), F.col("receipt"))
    checks = F.array(
        F.when(~unchained & (F.col("record_digest") != own), "digest"),
        F.when(~unchained & ~F.col("previous_record_digest").eqNullSafe(follows), "previous"),
        F.when(unchained & (F.col("place") > F.col("n_legacy")), "legacy_prefix"),
        F.when(F.col("sequence") != F.col("place"), "sequence"),
        F.when(F.col("same_run") > 1, "repeated_run"),
        F.when(F.col("place") > max_records, "capacity"),
    )
    return placed.select("task_id", "sequence", F.explode(F.array_compact(checks)).alias("rule"))


def expansion_ledger_digest(task_id: Column, base: Column, digests: Column) -> Column:
    """What a plan keeps of its expansions: the digest of the selection they began with and of their records in order."""
    parts = F.struct(base.alias("base_selection_digest"), digests.alias("record_digests"), F.lit("0.3").alias("schema_version"), task_id.alias("task_id"))
    return digest.text_hash(F.to_json(parts))


def expansion_ledger_violations(expansions: DataFrame, plans: DataFrame) -> DataFrame:
    """task_id, sequence (null: of the whole ledger) and rule of expansion ledgers that do not lead from a plan's first selection to its present one.

    expansions: task_id, sequence, previous_selection_digest, selection_digest, additions,
    known_ids, record_digest. plans: task_id, base_selection_digest, selection_digest,
    item_ids, expansion_ledger_digest.
    """
    order = Window.partitionBy("task_id").orderBy("sequence")
    plan = plans.select("task_id", "base_selection_digest", F.col("selection_digest").alias("plan_digest"), "item_ids", "expansion_ledger_digest")
    rows = expansions.join(plan, "task_id").withColumns({
        "place": F.row_number().over(order),
        "prior": F.coalesce(F.lag("selection_digest").over(order), F.col("base_selection_digest")),
        "added": F.flatten(F.collect_list("additions").over(order.rowsBetween(Window.unboundedPreceding, -1))),
        "later": F.flatten(F.collect_list("additions").over(order.rowsBetween(0, Window.unboundedFollowing))),
    })  # fmt: skip  # a ledger has MAX_EXPANSIONS records
    known = F.array_except("item_ids", "later")
    checks = F.array(
        F.when(F.col("previous_selection_digest") != F.col("prior"), "chain"),
        F.when(F.size(F.array_except(known, "known_ids")) > 0, "known_ids"),
        F.when((F.size("additions") == 0) & (F.col("selection_digest") != F.col("prior")), "denied_changes"),
        F.when(F.arrays_overlap("additions", "added") | (F.size(F.array_distinct("additions")) < F.size("additions")), "addition_repeated"),
        F.when(F.size(F.array_except("additions", "item_ids")) > 0, "addition_unknown"),
        F.when(F.col("place") > MAX_EXPANSIONS, "capacity"),
    )
    single = rows.select("task_id", "sequence", F.explode(F.array_compact(checks)).alias("rule"))
    ended = expansions.groupBy("task_id").agg(F.max_by("selection_digest", "sequence").alias("last"), F.transform(F.sort_array(F.collect_list(F.struct("sequence", "record_digest"))), lambda x: x["record_digest"]).alias("digests"))
    whole = plan.join(ended, "task_id", "left").withColumns({"last": F.coalesce("last", "base_selection_digest"), "digests": F.coalesce("digests", F.array().cast(STRINGS))})
    found = F.array(
        F.when(F.col("last") != F.col("plan_digest"), "tail"),
        F.when(F.col("expansion_ledger_digest") != expansion_ledger_digest(F.col("task_id"), F.col("base_selection_digest"), F.col("digests")), "anchor"),
    )
    orphans = expansions.join(plan.select("task_id"), "task_id", "left_anti").select("task_id", "sequence", F.lit("no_plan").alias("rule"))
    return single.unionByName(whole.select("task_id", F.lit(None).cast("long").alias("sequence"), F.explode(F.array_compact(found)).alias("rule"))).unionByName(orphans)


def repeated_runs(outcomes: DataFrame) -> DataFrame:
    """Runs recorded more than once for one selection of a task."""
    return outcomes.groupBy("task_id", "selection_digest", "run_id").agg(F.count("*").alias("records")).where("records > 1")


def used_outside_selection(outcomes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome records that claim evidence which was not selected."""
    selected = decisions.where("status = 'INCLUDED'").select("task_id", F.col("candidate_id").alias("used"))
    return outcomes.select("task_id", "run_id", F.explode("used_candidate_ids").alias("used")).join(selected, ["task_id", "used"], "left_anti")


def outcome(outcomes: DataFrame) -> DataFrame:
    """Outcome receipts: sorted lists, the fixed causality statement and the digest of all of it."""
    tidy = outcomes.withColumns({c: F.array_sort(F.array_distinct(c)) for c in ("used_candidate_ids", "touched_paths")}).withColumn("causality", F.lit("OBSERVATIONAL_ONLY"))
    return tidy.withColumn("outcome_digest", digest.struct_hash(F.struct(*sorted(tidy.columns))))


def expansion_violations(expansions: DataFrame) -> DataFrame:
    """Expansions (task_id, sequence, previous_selection_digest, selection_digest, additions) that do not follow one another."""
    order = Window.partitionBy("task_id").orderBy("sequence")
    linked = expansions.withColumn("before", F.lag("selection_digest").over(order)).withColumn("place", F.row_number().over(order))
    broken = linked.where((F.col("before").isNotNull() & (F.col("before") != F.col("previous_selection_digest"))) | (F.col("place") > MAX_EXPANSIONS)).select("task_id", "sequence", F.lit("chain").alias("rule"))
    twice = expansions.select("task_id", "sequence", F.explode("additions").alias("a")).withColumn("n", F.row_number().over(Window.partitionBy("task_id", "a").orderBy("sequence")))
    return broken.unionByName(twice.where("n > 1").select("task_id", "sequence", F.lit("addition_repeated").alias("rule")))


def drifted(previous: DataFrame, current: DataFrame) -> DataFrame:
    """task_id, candidate_id and change (added, removed) of all that came or went between two selections (task_id, candidate_id)."""
    a = previous.select("task_id", "candidate_id").withColumn("side", F.lit(1))
    b = current.select("task_id", "candidate_id").withColumn("side", F.lit(2))
    sides = a.unionByName(b).groupBy("task_id", "candidate_id").agg(F.bit_or("side").alias("sides")).where("sides <> 3")
    return sides.select("task_id", "candidate_id", F.when(F.col("sides") == 1, "removed").otherwise("added").alias("change"))


def replay_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """task_id, added, removed (counts) and status of every task of either selection; drifted() has the ids."""
    ids = previous.select("task_id").unionByName(current.select("task_id")).groupBy("task_id").agg(F.lit(1).alias("one")).select("task_id")
    now = current.groupBy("task_id").agg(F.count("*").alias("now"))
    moved = drifted(previous, current).groupBy("task_id").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    rows = ids.join(now, "task_id", "left").join(moved, "task_id", "left").na.fill(0, ["added", "removed"])
    status = F.when(F.col("now").isNull(), "UNREPLAYABLE").when(F.col("added") + F.col("removed") == 0, "IDENTICAL").otherwise("DRIFTED")
    return rows.select("task_id", "added", "removed", status.alias("status"))


def ablate_all(decisions: DataFrame) -> DataFrame:
    """Every single-item ablation at once: what each criterion loses when one selected item goes.

    An item only touches the criteria it covers, so instead of pairing every item with
    every criterion's items, each (criterion, term) is counted once and an item's loss is
    the terms that only it holds. task_id, candidate_id, decision, missing_criteria_ids,
    missing_required_terms.
    """
    needs = decisions.groupBy("task_id").agg(F.first("requirements").alias("r")).select("task_id", F.inline("r"))
    taken = decisions.where("status = 'INCLUDED'").select("task_id", "candidate_id", "mandatory", F.col("criterion_terms").alias("ct"))
    held = taken.select("task_id", "candidate_id", F.inline("ct")).withColumnRenamed("terms", "held")
    single = held.select("task_id", "id", "candidate_id", F.explode("held").alias("term"))
    per_term = single.groupBy("task_id", "id", "term").agg(F.count("*").alias("n"))
    rest = single.join(per_term, ["task_id", "id", "term"]).groupBy("task_id", "id", "candidate_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.col("term")))).alias("alone"))
    all_terms = per_term.groupBy("task_id", "id").agg(F.collect_set("term").alias("matched"))
    base = needs.join(all_terms, ["task_id", "id"], "left").withColumn("matched", F.coalesce("matched", F.array().cast(STRINGS)))
    need = F.struct("mode", "terms", "minimum")
    base = base.withColumn("met", satisfied(need, F.col("matched")))
    lost = base.join(rest, ["task_id", "id"]).withColumn("left", F.array_except("matched", "alone")).withColumn("still", satisfied(need, F.col("left")))

    def lacking(have: str):
        gone = F.array_except("terms", have)
        return F.when(F.col("mode") == "AT_LEAST", F.slice(gone, 1, F.greatest(F.col("minimum") - F.size(have), F.lit(0)))).otherwise(gone)

    changed = lost.select("task_id", "candidate_id", "id", (~F.col("still")).alias("missing"), lacking("left").alias("gone"))
    before = base.select("task_id", "id", (~F.col("met")).alias("missing0"), lacking("matched").alias("gone0"))
    pairs = taken.select("task_id", "candidate_id", "mandatory").join(before, "task_id").join(changed, ["task_id", "candidate_id", "id"], "left")
    keep = F.col("mandatory")
    missing = F.when(keep, F.col("missing0")).otherwise(F.coalesce("missing", "missing0"))
    gone = F.when(keep, F.col("gone0")).otherwise(F.coalesce("gone", "gone0"))
    return pairs.groupBy("task_id", "candidate_id", "mandatory").agg(F.array_sort(F.collect_list(F.when(missing, F.col("id")))).alias("missing_criteria_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(gone)))).alias("missing_required_terms")).select(
        "task_id", "candidate_id", F.when(keep, "DENIED").otherwise("DERIVED").alias("decision"), F.when(keep, "MANDATORY_CANDIDATE").otherwise("NON_MANDATORY_REMOVED").alias("reason"), "missing_criteria_ids", "missing_required_terms"
    )


def receipt_violations(decisions: DataFrame) -> DataFrame:
    """task_id, candidate_id and rule of decisions whose score, reason class or duplicate link does not hold."""
    parts = [f.name for f in decisions.schema["components"].dataType.fields]
    included = decisions.where("status = 'INCLUDED'").select("task_id", F.col("candidate_id").alias("duplicate_of"), F.lit(True).alias("head"))
    rows = decisions.join(included, ["task_id", "duplicate_of"], "left")
    checks = F.array(
        F.when(F.col("score") != sum((F.col(f"components.{p}") for p in parts), F.lit(0)), "score"),
        F.when(~F.when(F.col("status") == "INCLUDED", F.startswith("reason", F.lit("INCLUDE_"))).otherwise(F.startswith("reason", F.lit("OMIT_"))), "reason"),
        F.when(F.col("duplicate_of").isNotNull() & F.col("head").isNull(), "duplicate_link"),
    )
    return rows.select("task_id", "candidate_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("rule"))
