"""The public verbs: catalog and search, index, plan, expand, outcome, replay, ablate, map, metrics.

Each takes and returns DataFrames, except ``plan`` and what follows from it, which work on
one task whose evidence is bounded (at most 2,048 candidates) and return plain documents
with digests.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import screen, text
from ..functions.digest import json_hash
from ..operators import candidates as cand
from ..operators import catalog, fts, graph, ledger, metrics, repo_map, requests, schema, scoring, search, selection
from ..sources import repository, stores, tree
from ..sources.scratch import cut
from ..sources.tables import table

build_catalog, search_documents, build_index, search_index = catalog.build, search.search, fts.build, fts.search
publish_catalog, publish_index, read_index, search_index_many = catalog.publish, fts.reuse_or_publish, fts.read, fts.search_many
append_outcomes, outcomes, insert_if_absent, schema_violations, scan_metrics = stores.append_outcomes, stores.outcomes, stores.insert_if_absent, schema.violations, metrics.scan
modules, metric_totals, compare_arms, capsule, validate_handoff = repo_map.modules, metrics.totals, metrics.compare_arms, requests.capsule, requests.validate_handoff
POLICY_VERSION = "1"
MAX_MODULES = 512


def observe(spark: SparkSession, root: str, excludes: list[str] | None = None, mounted: bool = False) -> dict[str, Any]:
    """One observation of a repository: documents, files, modules and the identity of all accepted sources.

    mounted: root is a folder that all executors see; links are not followed then, ceilings
    hold, and a file that changes while it is read is an error.
    """
    files = cut(tree.files(tree.walk(spark, root, excludes), root) if mounted else repository.walk(spark, root, excludes))
    docs = cut(repository.documents(files))
    rest = cut(repository.fallback(files, docs))
    accepted = repository.hybrid(docs, rest)
    identity = repository.observation_digest(accepted).first()
    name = root.rstrip("/").rsplit("/", 1)[-1]
    modules = cut(repo_map.modules(files))
    counters = catalog.summary(files).first().asDict()
    listed = [r.asDict() for r in modules.orderBy("path", "id").limit(MAX_MODULES).collect()]
    snapshot = {"repository_id": requests.repository_id(name, root), "worktree_digest": json_hash({"sources": identity["sources"], "identity": str(identity["identity"]), "documents": counters, "modules": listed})}
    return {"sources": accepted, "documents": docs, "files": rest, "modules": modules, "snapshot": snapshot}


def task_row(spark: SparkSession, of: dict[str, Any], budget: dict[str, int] | None = None) -> DataFrame:
    """A request as the one-row task table that scoring reads."""
    t, b = of["task"], budget or of["budget"]
    criteria = [(c["id"], c["text"], c.get("required_terms")) for c in t["acceptance_criteria"]]
    hints = t.get("hints", {})
    row = (t["task_id"], t["goal"], t["query"], criteria, hints.get("paths", []), hints.get("symbols", []), hints.get("terms", []), of.get("required_sources", []), b["max_items"], b["max_bytes"], b["max_estimated_tokens"])
    return spark.createDataFrame([row], scoring.TASKS)


def gather(tasks: DataFrame, seen: dict[str, Any], nodes: DataFrame | None = None, index: fts.Index | None = None) -> DataFrame:
    """Candidates of all providers for the tasks, capped; with an index, documents that it hits are taken from there."""
    return gathered(tasks, seen, nodes, index)[0]


def gathered(tasks: DataFrame, seen: dict[str, Any], nodes: DataFrame | None = None, index: fts.Index | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(candidates, index hits whose source changed since: task_id, path, code; none without an index)."""
    tasks = cand.asking(tasks)
    docs = seen["documents"].withColumn("kind", F.lit("document"))
    direct, stale = cand.of_sources(tasks, docs, "documents"), None
    made = [direct, cand.of_sources(tasks, seen["files"], "filesystem")]
    listing = [r.asDict() for r in seen["modules"].limit(MAX_MODULES).collect()]
    made.append(cand.of_text(tasks, "repo_map", "repository_map", "repo-map.json", json.dumps(listing, ensure_ascii=False, separators=(",", ":")), True))
    if index is not None:
        hits = fts.search_many(index, tasks.select("task_id", "query"))
        found, stale = cand.of_index(tasks, hits, seen["sources"])
        found = cut(found)
        made[0] = cand.without_indexed(direct, found, tasks)
        made.append(found)
    if nodes is not None:
        made.append(cand.of_nodes(tasks, nodes, seen["sources"]))
    return cand.aggregate(tasks, made), stale


def compile_task(spark: SparkSession, of: dict[str, Any], candidates: DataFrame, failures: list[dict] | None = None, budget: dict[str, int] | None = None, tier: str | None = None, retained: list[str] | None = None, asked: dict[str, Any] | None = None) -> dict[str, Any]:
    """Envelope and receipt of one task, with digests over canonical JSON."""
    failures = source_failures(spark, failures or [])
    blocked = any(f["security_control"] and f["code"] == "REQUIRED_SOURCE_BLOCKED" for f in failures)
    if any(f["security_control"] and f["code"] != "REQUIRED_SOURCE_BLOCKED" for f in failures):
        raise requests.RequestError("a security control of a source failed")
    rows = candidates.withColumn("retained", F.col("id").isin(retained or []) if retained else F.lit(False))
    if asked:
        named = F.lit(False)
        for p in asked.get("requested_paths", []):
            named = named | (F.col("path") == p) | F.startswith("path", F.lit(p + "/"))
        for s in asked.get("requested_symbols", []):
            named = named | F.coalesce(F.col("symbol") == s, F.lit(False))
        terms = F.array(*[F.lit(t) for x in asked.get("requested_terms", []) for t in search.query_terms(x)]).cast("array<string>")
        found = F.array_sort(F.array_intersect(terms, text.tokens(F.concat_ws(" ", "path", F.coalesce("symbol", F.lit("")), "excerpt"))))
        rows = rows.withColumn("requested_terms", found).withColumn("requested", ~F.col("retained") & (named | (F.size("requested_terms") > 0)))
    if candidates.groupBy("id").count().where("count > 1").limit(1).count():
        raise requests.RequestError("a candidate id is repeated")
    scored = cut(scoring.score(task_row(spark, of, budget), rows))
    decisions, found_conflicts = (cut(d) for d in selection.select(scored, blocked))
    covered = selection.coverage(decisions, found_conflicts)
    state = selection.status(decisions, covered, found_conflicts, blocked).first()
    chosen = {r["candidate_id"]: r for r in decisions.where("status = 'INCLUDED'").select("candidate_id", "reason", "position").collect()}
    fields = ["id", "kind", "provider", "path", "line_start", "line_end", "symbol", "source_hash", "excerpt_hash", "authority", "excerpt", "excerpt_bytes", "estimated_tokens", "matched_terms", "criteria_ids", "mandatory", "score", "components"]
    items = sorted((r.asDict(True) for r in scored.where(F.col("id").isin(list(chosen))).select(*fields).collect()), key=lambda r: chosen[r["id"]]["position"]) if chosen else []
    limits = budget or of["budget"]
    envelope = {
        "schema_version": "0.3", "task_id": of["task"]["task_id"], "request_digest": json_hash(of), "policy_version": POLICY_VERSION, "snapshot": of["snapshot"], "budget_tier": tier,
        "evidence_status": state["evidence_status"] if state else "INSUFFICIENT_EVIDENCE", "budget_status": state["budget_status"] if state else "WITHIN_BUDGET",
        "budget": limits | {"used_items": state["used_items"], "used_bytes": state["used_bytes"], "used_tokens": state["used_tokens"]} if state else limits | {"used_items": 0, "used_bytes": 0, "used_tokens": 0},
        "items": [r | {"selection_reason": chosen[r["id"]]["reason"]} for r in items],
        "criteria_coverage": [r.asDict(True) for r in covered.drop("task_id").orderBy("criterion_id").collect()],
        "missing_required_sources": state["missing_required_sources"] if state else of["required_sources"], "missing_required_terms": state["missing_required_terms"] if state else [],
        "conflicts": [r.asDict(True) for r in found_conflicts.drop("task_id").orderBy("conflict_key").collect()], "source_failures": failures,
    }
    envelope["selection_digest"] = json_hash(envelope)
    listed = decisions.select("candidate_id", "status", "reason", "mandatory", "score", "components", "marginal_criteria_ids", "marginal_terms", "duplicate_of").orderBy("candidate_id").collect()
    receipt = {"schema_version": "0.3", "task_id": envelope["task_id"], "selection_digest": envelope["selection_digest"], "decisions": [r.asDict(True) for r in listed]}
    return {"envelope": envelope, "receipt": receipt | {"receipt_digest": json_hash(receipt)}, "decisions": decisions}


def source_failures(spark: SparkSession, failures: list[dict]) -> list[dict]:
    """Failures with redacted, bounded messages, in order."""
    if not failures:
        return []
    rows = spark.createDataFrame([(f["provider"], f["code"], f.get("message", ""), bool(f.get("security_control"))) for f in failures], "provider string, code string, message string, security_control boolean")
    return [r.asDict() for r in rows.withColumn("message", F.substring(screen.redact(F.col("message")), 1, 4096)).orderBy("provider", "code", "message", "security_control").collect()]


def prepare(spark: SparkSession, root: str, goal: str, **more: Any) -> dict[str, Any]:
    """From a goal in words to selected evidence of a repository."""
    seen = observe(spark, root)
    of = requests.request(requests.intent(goal, **more), seen["snapshot"])
    return compile_task(spark, of, gather(task_row(spark, of), seen)) | {"request": of}


def verify(package: dict[str, Any]) -> list[str]:
    """What is wrong with a package's digests and links; empty if nothing."""
    envelope, receipt = package["envelope"], package["receipt"]
    errors = []
    if json_hash({k: v for k, v in envelope.items() if k != "selection_digest"}) != envelope["selection_digest"]:
        errors.append("selection digest")
    if json_hash({k: v for k, v in receipt.items() if k != "receipt_digest"}) != receipt["receipt_digest"]:
        errors.append("receipt digest")
    if receipt["selection_digest"] != envelope["selection_digest"]:
        errors.append("receipt is of another selection")
    if {d["candidate_id"] for d in receipt["decisions"] if d["status"] == "INCLUDED"} != {i["id"] for i in envelope["items"]}:
        errors.append("items and decisions differ")
    return errors


def expand(spark: SparkSession, package: dict[str, Any], of: dict[str, Any], asked: dict[str, Any], candidates: DataFrame) -> tuple[dict[str, Any], dict[str, Any]]:
    """(package, decision) of a request for more evidence; a denial leaves the package as it was."""
    before = package["envelope"]
    kept = [i["id"] for i in before["items"]]
    denied = lambda *codes: (package, {"status": "DENIED", "reason_codes": list(codes), "additions": [], "selection_digest": before["selection_digest"]})
    if asked["previous_selection_digest"] != before["selection_digest"] or json_hash(of) != before["request_digest"] or not set(kept) <= set(asked["known_candidate_ids"]):
        return denied("STALE_PARENT")
    tier, budget = requests.expansion_budget(of, before["budget"] | {"tier": before.get("budget_tier")}, asked["additional_budget"])
    after = compile_task(spark, of, candidates, before["source_failures"], budget, tier, kept, asked)
    additions = sorted(i["id"] for i in after["envelope"]["items"] if i["id"] not in kept)[:64]
    cut_off = any(d["reason"].startswith("OMIT_BUDGET") for d in after["receipt"]["decisions"]) and tier in (None, "HARD")
    if not additions:
        copies = {d["candidate_id"] for d in after["receipt"]["decisions"] if d["duplicate_of"]}
        every = {d["candidate_id"] for d in after["receipt"]["decisions"]}
        return denied("DUPLICATE_ONLY" if every and every <= copies | set(kept) and copies else "HARD_LIMIT_REACHED" if cut_off else "NO_NEW_EVIDENCE")
    missing = remaining_evidence(after["envelope"])
    codes = ["EVIDENCE_ADDED", *(["HARD_LIMIT_REACHED"] if cut_off else [])]
    return after, {"status": "PARTIAL" if missing or cut_off else "ALLOWED", "reason_codes": codes, "additions": additions, "budget_tier": tier, "selection_digest": after["envelope"]["selection_digest"], "remaining_missing_evidence": missing}


def remaining_evidence(envelope: dict[str, Any]) -> list[str]:
    open_criteria = [c["criterion_id"] for c in envelope["criteria_coverage"] if c["status"] != "COVERED"]
    return sorted({*open_criteria, *envelope["missing_required_sources"], *envelope["missing_required_terms"]})


def replay(previous: dict[str, Any], current: dict[str, Any] | None) -> dict[str, Any]:
    """How a selection compares with the one made before."""
    a, b = previous["envelope"], (current or {}).get("envelope")
    old, new = {i["id"] for i in a["items"]}, {i["id"] for i in b["items"]} if b else set()
    out = {
        "status": "UNREPLAYABLE" if b is None else "IDENTICAL" if a["selection_digest"] == b["selection_digest"] else "DRIFTED",
        "added_candidate_ids": sorted(new - old), "removed_candidate_ids": sorted(old - new),
        "freshness": "UNAVAILABLE" if b is None else "MATCHED" if a["snapshot"]["worktree_digest"] == b["snapshot"]["worktree_digest"] else "CHANGED",
    }
    return out | {"replay_digest": json_hash(out)}


def ablate(package: dict[str, Any], candidate_id: str) -> dict[str, Any]:
    """What would be missing without one selected item."""
    row = ledger.ablate_all(package["decisions"]).where(F.col("candidate_id") == candidate_id).first()
    return row.asDict(True) if row else {"candidate_id": candidate_id, "decision": "DENIED", "reason": "CANDIDATE_NOT_SELECTED"}


def record_outcome(outcomes: DataFrame) -> DataFrame:
    return ledger.outcome(outcomes)


def code_graph(files: DataFrame) -> DataFrame:
    return graph.extract_nodes(files)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name)
