"""Duplicates, conflicts and the budgeted greedy choice of evidence.

Each task has at most 2,048 candidates (``candidates.aggregate`` sees to that), so the one
sequential step, a greedy cover under three budgets, is a grouped function of bounded size
keyed by task. Everything around it is windows and aggregates.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from . import vocabulary as v
from .scoring import MAX_CANDIDATES, STRINGS, satisfied


def duplicates(scored: DataFrame) -> DataFrame:
    """scored with representative: the id that stands for all candidates of the same content in the task.

    Retained candidates keep their place: each represents itself, the first also the fresh
    optional copies, while fresh mandatory copies form a group of their own.
    """
    rank = F.when(F.col("recognised"), F.array_position(F.array(*[F.lit(a) for a in v.AUTHORITY_ORDER]), F.col("authority"))).otherwise(99)
    locator = F.length(F.concat_ws(":", "path", F.coalesce(F.col("line_start").cast("string"), F.lit("")), F.coalesce("symbol", F.lit(""))))
    content = Window.partitionBy("task_id", "source_hash", "excerpt_hash")
    preferred = content.orderBy(F.desc("retained"), F.desc("mandatory"), rank, locator, "order")
    within = scored.withColumn("any_retained", F.max("retained").over(content)).withColumn(
        "lane", F.when(F.col("any_retained") & F.col("retained"), F.concat(F.lit("kept:"), "id")).when(F.col("any_retained") & F.col("mandatory"), "fresh").otherwise("all")
    )
    lead = F.first("id").over(preferred)
    own = F.first("id").over(Window.partitionBy("task_id", "source_hash", "excerpt_hash", "lane").orderBy(F.desc("mandatory"), rank, locator, "order"))
    return within.withColumn("representative", F.when(F.col("lane") == "all", lead).otherwise(own)).drop("any_retained", "lane")


def conflicts(grouped: DataFrame) -> DataFrame:
    """Groups of recognised authorities that say different things in one place: task_id, conflict_key, candidate_ids, criterion_ids."""
    able = grouped.where((F.col("id") == F.col("representative")) & F.col("recognised") & F.col("authority").isin(*v.CONFLICTING))
    by_topic = F.transform("criteria_ids", lambda c: F.concat(F.lit("topic:criterion:"), c))
    by_path = F.array(F.concat_ws(":", F.lit("path"), "path", F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0))))
    locators = F.when(F.col("symbol").isNotNull(), F.array(F.concat(F.lit("symbol:"), "symbol"))).when((F.col("kind") == "document") & (F.size("criteria_ids") > 0), by_topic).otherwise(by_path)
    return (
        able.select("task_id", "id", "source_hash", "criteria_ids", F.explode(locators).alias("locator"))
        .groupBy("task_id", "locator")
        .agg(
            F.count_distinct("source_hash").alias("variants"),
            F.array_sort(F.collect_set("id")).alias("candidate_ids"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("criteria_ids")))).alias("criterion_ids"),
        )
        .where("variants > 1")
        .select("task_id", F.concat(F.lit("conflict-"), F.sha2(F.col("locator").cast("binary"), 256)).alias("conflict_key"), "candidate_ids", "criterion_ids")
    )


CHOICE = "task_id string, candidate_id string, status string, reason string, marginal_criteria_ids array<string>, marginal_terms array<string>, position int, mandatory_exhausted boolean"


def choose(rows: pd.DataFrame, blocked: bool = False) -> pd.DataFrame:
    """Decisions over the representatives of one task: retained, then mandatory first-fit, then greedy cover."""
    rows = rows.sort_values("rank", ignore_index=True)
    needs = {r["id"]: (r["mode"], frozenset(r["terms"]), int(r["minimum"])) for r in rows.at[0, "requirements"]}
    limits = [int(rows.at[0, c]) for c in ("max_items", "max_bytes", "max_tokens")]
    used, covered, decisions, chosen = [0, 0, 0], {c: set() for c in needs}, {}, []
    keys = [{m["id"]: frozenset(m["terms"]) for m in ms if m["id"] in needs} for ms in rows["criterion_terms"]]

    def over(k: int) -> str | None:
        cost = (1, int(rows.at[k, "excerpt_bytes"]), int(rows.at[k, "estimated_tokens"]))
        return next((f"OMIT_BUDGET_{n}" for n, u, c, m in zip(("ITEMS", "BYTES", "TOKENS"), used, cost, limits, strict=True) if u + c > m), None)

    def take(k: int) -> None:
        for j, c in enumerate((1, int(rows.at[k, "excerpt_bytes"]), int(rows.at[k, "estimated_tokens"]))):
            used[j] += c
        chosen.append(k)

    def met(criterion: str) -> bool:
        mode, terms, minimum = needs[criterion]
        have = covered[criterion]
        return (terms <= have if terms else bool(have)) if mode == "ALL" else len(have) >= minimum

    def gain(k: int) -> list[tuple[str, str]]:
        return sorted((c, t) for c, terms in keys[k].items() if not met(c) for t in terms - covered[c])

    exhausted = False
    for phase in ("retained", "mandatory"):
        for k in rows.index[rows[phase] & ~rows.index.isin(decisions)]:
            reason = over(k)
            if reason and phase == "retained":
                raise ValueError("retained evidence no longer fits its budget")
            if reason:
                exhausted, decisions[k] = True, ("OMITTED", reason, [])
                continue
            take(k)
            decisions[k] = ("INCLUDED", rows.at[k, "first_reason"], sorted((c, t) for c, ts in keys[k].items() for t in ts))
    for k in chosen:
        for c, terms in keys[k].items():
            covered[c] |= terms
    left = {k for k in rows.index if k not in decisions}
    flags = {k: (not rows.at[k, "conflicted"], not rows.at[k, "requested"], -int(rows.at[k, "score"]), k) for k in left}
    # What a candidate adds only shrinks as others are taken, so the gain noted last is an upper bound: the best one
    # whose noted gain still holds is the best of all, and the others' gains need not be computed.
    heap = [(-sum(len(ts) for ts in keys[k].values()), *flags[k]) for k in left]
    heapq.heapify(heap)
    while heap:
        noted, best = -heap[0][0], heap[0][-1]
        found = gain(best)
        if len(found) < noted:
            heapq.heapreplace(heap, (-len(found), *flags[best]))
            continue
        if not found and flags[best][0] and flags[best][1]:
            have = set().union(*(rows.at[k, "group_paths"] for k in chosen)) if chosen else set()
            enough = all(map(met, needs)) and set(rows.at[0, "required_sources"]) <= have and not blocked and not exhausted
            for k in left:
                decisions[k] = ("OMITTED", "OMIT_SUFFICIENT_EVIDENCE" if enough else "OMIT_NO_MATCH" if rows.at[k, "score"] == 0 else "OMIT_LOWER_MARGINAL_COVERAGE", [])
            break
        heapq.heappop(heap)
        left.remove(best)
        reason = over(best)
        if reason:
            decisions[best] = ("OMITTED", reason, found)
            continue
        take(best)
        for c, t in found:
            covered[c].add(t)
        decisions[best] = ("INCLUDED", "INCLUDE_CRITERION_COVERAGE" if found else "INCLUDE_RELEVANCE", found)
    place = {k: n for n, k in enumerate(chosen)}
    out = []
    for k, (status, reason, pairs) in decisions.items():
        if status == "OMITTED" and rows.at[k, "conflicted"] and not reason.startswith("OMIT_BUDGET"):
            reason = "OMIT_CONFLICT_REVIEW"
        terms = {t for _, t in pairs} | (set(rows.at[k, "requested_terms"]) if status == "INCLUDED" and rows.at[k, "requested"] else set())
        out.append((rows.at[k, "task_id"], rows.at[k, "id"], status, reason, sorted({c for c, _ in pairs}), sorted(terms), place.get(k), exhausted))
    return pd.DataFrame(out, columns=[f.split()[0] for f in CHOICE.split(", ")]).astype({"position": "Int32"})


def select(scored: DataFrame, blocked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(decisions, conflicts): every candidate's status, reason, marginal evidence, score and representative."""
    grouped = duplicates(scored)
    found = conflicts(grouped)
    involved = found.select("task_id", F.explode("candidate_ids").alias("id")).distinct().withColumn("conflicted", F.lit(True))
    group_paths = F.collect_set("path").over(Window.partitionBy("task_id", "representative"))
    heads = grouped.withColumn("group_paths", group_paths).where(F.col("id") == F.col("representative")).join(involved, ["task_id", "id"], "left").withColumn("conflicted", F.coalesce("conflicted", F.lit(False)))
    if "requested_terms" not in scored.columns:
        heads = heads.withColumn("requested_terms", F.array().cast(STRINGS))
    inputs = heads.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("order"))).select(
        "task_id", "id", "rank", "retained", "mandatory", "requested", "conflicted", "score", "first_reason", "excerpt_bytes", "estimated_tokens",
        "requirements", "criterion_terms", "requested_terms", "required_sources", "group_paths", "max_items", "max_bytes", "max_tokens",
    )
    chosen = inputs.groupBy("task_id").applyInPandas(lambda rows: choose(rows, blocked), CHOICE)
    head = chosen.select("task_id", F.col("candidate_id").alias("representative"), *[F.col(c).alias(f"h_{c}") for c in ("status", "reason", "marginal_criteria_ids", "marginal_terms", "position", "mandatory_exhausted")])
    alias = F.col("id") != F.col("representative")
    linked = alias & (F.col("h_status") == "INCLUDED")
    none = F.array().cast(STRINGS)
    decisions = grouped.join(head, ["task_id", "representative"]).select(
        "task_id", F.col("id").alias("candidate_id"),
        F.when(alias, "OMITTED").otherwise(F.col("h_status")).alias("status"),
        F.when(linked, "OMIT_DUPLICATE_CONTENT").otherwise(F.col("h_reason")).alias("reason"),
        "mandatory", "score", "components",
        F.when(alias, none).otherwise(F.col("h_marginal_criteria_ids")).alias("marginal_criteria_ids"),
        F.when(alias, none).otherwise(F.col("h_marginal_terms")).alias("marginal_terms"),
        F.when(linked, F.col("representative")).alias("duplicate_of"),
        F.when(~alias, F.col("h_position")).alias("position"),
        F.col("h_mandatory_exhausted").alias("mandatory_exhausted"),
        "path", "excerpt_bytes", "estimated_tokens", "criterion_terms", "requirements", "required_sources", "source_hash",
    )
    return decisions, found


def coverage(decisions: DataFrame, found: DataFrame) -> DataFrame:
    """task_id, criterion_id, mode, status, candidate_ids, matched_terms, missing_terms of every criterion."""
    needs = decisions.groupBy("task_id").agg(F.first("requirements").alias("requirements")).select("task_id", F.inline("requirements"))
    taken = decisions.where("status = 'INCLUDED'").select("task_id", "candidate_id", F.inline("criterion_terms"))
    matched = taken.groupBy("task_id", "id").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("matched_terms"))
    disputed = found.select("task_id", F.explode("criterion_ids").alias("id")).distinct().withColumn("disputed", F.lit(True))
    rows = needs.join(matched.withColumnRenamed("terms", "m_terms"), ["task_id", "id"], "left").join(disputed, ["task_id", "id"], "left")
    have = F.coalesce("matched_terms", F.array().cast(STRINGS))
    ok = satisfied(F.struct("mode", "terms", "minimum"), have)
    status = F.when(F.col("disputed"), "CONFLICTED").when(ok, "COVERED").otherwise("MISSING")
    lacking = F.array_except("terms", have)
    short = F.when(F.col("mode") == "AT_LEAST", F.slice(lacking, 1, F.greatest(F.col("minimum") - F.size(have), F.lit(0)))).otherwise(lacking)
    return rows.select(
        "task_id", F.col("id").alias("criterion_id"), "mode", "terms", "minimum", status.alias("status"), F.coalesce("candidate_ids", F.array().cast(STRINGS)).alias("candidate_ids"),
        have.alias("matched_terms"), F.when(status == "COVERED", F.array().cast(STRINGS)).otherwise(short).alias("missing_terms"),
    )


def status(decisions: DataFrame, covered: DataFrame, found: DataFrame, blocked: bool = False) -> DataFrame:
    """One row a task: evidence and budget status, what was used and what is missing."""
    taken = F.col("status") == "INCLUDED"
    included_paths = decisions.where("status = 'INCLUDED'").select("task_id", F.col("candidate_id").alias("r"))
    all_paths = decisions.select("task_id", F.coalesce("duplicate_of", "candidate_id").alias("r"), "path").join(included_paths, ["task_id", "r"], "left_semi").groupBy("task_id").agg(F.collect_set("path").alias("paths"))
    used = decisions.groupBy("task_id").agg(
        F.count("*").alias("considered"),
        F.count_if(taken).alias("used_items"),
        F.coalesce(F.sum(F.when(taken, F.col("excerpt_bytes"))), F.lit(0)).cast("long").alias("used_bytes"),
        F.coalesce(F.sum(F.when(taken, F.col("estimated_tokens"))), F.lit(0)).cast("long").alias("used_tokens"),
        F.max("mandatory_exhausted").alias("exhausted"),
        F.max(F.startswith("reason", F.lit("OMIT_BUDGET"))).alias("cut"),
        F.first("required_sources").alias("required_sources"),
    )
    gaps = covered.groupBy("task_id").agg(F.max(F.col("status") != "COVERED").alias("gap"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing_terms")))).alias("missing_required_terms"))
    disputed = found.groupBy("task_id").agg(F.count("*").alias("conflicts"))
    rows = used.join(gaps, "task_id", "left").join(disputed, "task_id", "left").join(all_paths, "task_id", "left")
    missing = F.array_except("required_sources", F.coalesce("paths", F.array().cast(STRINGS)))
    lacking = F.col("exhausted") | F.lit(blocked) | F.coalesce("gap", F.lit(False)) | (F.size(missing) > 0)
    return rows.select(
        "task_id",
        F.when(F.coalesce("conflicts", F.lit(0)) > 0, "CONFLICT").when(lacking, "INSUFFICIENT_EVIDENCE").otherwise("READY").alias("evidence_status"),
        F.when(F.col("exhausted"), "EXHAUSTED").when(F.col("cut"), "TRUNCATED").otherwise("WITHIN_BUDGET").alias("budget_status"),
        "considered", "used_items", "used_bytes", "used_tokens", missing.alias("missing_required_sources"),
        F.coalesce("missing_required_terms", F.array().cast(STRINGS)).alias("missing_required_terms"), F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflict_count"),
    )


def first_fit(candidates: DataFrame) -> DataFrame:
    """The mandatory phase alone, natively: in order, each row that still fits is taken and a misfit is skipped.

    rows: task_id, id, order, excerpt_bytes, estimated_tokens and the three limits. A
    running sum would be wrong, because skipped rows use no budget. A task has its first
    MAX_CANDIDATES candidates, as everywhere.
    """
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("order", "id"))
    candidates = candidates.withColumn("place", place).where(F.col("place") <= MAX_CANDIDATES)  # also applied before the shuffle
    item = F.struct("place", "id", F.col("excerpt_bytes").cast("long").alias("b"), F.col("estimated_tokens").cast("long").alias("t"))
    per_task = candidates.groupBy("task_id").agg(F.array_sort(F.collect_list(item)).alias("items"), *[F.first(c).cast("long").alias(c) for c in ("max_items", "max_bytes", "max_tokens")])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("t"), F.array().cast(STRINGS).alias("ids"))

    def step(a, x):
        fits = (a["n"] < F.col("max_items")) & (a["b"] + x["b"] <= F.col("max_bytes")) & (a["t"] + x["t"] <= F.col("max_tokens"))
        taken = F.struct((a["n"] + 1).alias("n"), (a["b"] + x["b"]).alias("b"), (a["t"] + x["t"]).alias("t"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))
        return F.when(fits, taken).otherwise(a)

    return per_task.select("task_id", F.aggregate("items", start, step).alias("r")).select("task_id", F.col("r.ids").alias("ids"), F.col("r.n").alias("used_items"), F.col("r.b").alias("used_bytes"), F.col("r.t").alias("used_tokens"))


def envelope_digest(decisions: DataFrame) -> DataFrame:
    """task_id and a digest over each task's selected ids in order and all its decisions by id."""
    rows = F.array_sort(F.collect_list(F.struct("candidate_id", "status", "reason", "score")))
    picked = F.transform(F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "candidate_id")))), lambda x: x["candidate_id"])
    return decisions.groupBy("task_id").agg(picked.alias("items"), rows.alias("rows")).select("task_id", digest.struct_hash(F.struct("task_id", "items", "rows")).alias("selection_digest"))
