"""Selection against a plain-Python model, with permuted inputs, and what follows from decisions."""

import random

import pandas as pd
import pytest

from siftline.operators import ledger, scoring, selection
from siftline.sources.scratch import cut

COLUMNS = (
    "task_id string, id string, kind string, provider string, path string, line_start int, line_end int, symbol string, source_hash string, excerpt_hash string, freshness string, "
    "authority string, authority_evidence array<string>, excerpt string, excerpt_bytes long, estimated_tokens long, graph_distance int, matched_terms array<string>"
)


def candidate(k, words, **more):
    text = f"evidence {words}"
    row = dict(task_id="T", id=f"c{k:03d}", kind="source_code", provider="filesystem", path=f"src/f{k}.ts", line_start=None, line_end=None, symbol=None, source_hash=f"h{k}", excerpt_hash=f"e{k}",
               freshness="live", authority="source_code", authority_evidence=[], excerpt=text, excerpt_bytes=len(text), estimated_tokens=-(-len(text) // 4), graph_distance=None, matched_terms=[])
    return tuple((row | more)[c.split()[0]] for c in COLUMNS.split(", "))


def task(spark, items=2, size=800, tokens=200, required=(), paths=(), query="compiler receipt security", criteria=None):
    criteria = criteria or [("AC-1", "x", ["receipt"]), ("AC-2", "y", ["security"])]
    return spark.createDataFrame([("T", "goal", query, criteria, list(paths), [], [], list(required), items, size, tokens)], scoring.TASKS)


def decide(spark, tasks, rows):
    decisions, conflicts = selection.select(cut(scoring.score(tasks, spark.createDataFrame(rows, COLUMNS))))
    return cut(decisions), cut(conflicts)


def by_id(decisions):
    return {r["candidate_id"]: (r["status"], r["reason"], r["position"]) for r in decisions.collect()}


def test_policy_first_and_order_independent(spark):
    policy = candidate(1, "security", path="AGENTS.md", provider="documents", kind="document", authority="policy", authority_evidence=["convention:root-agents-file"])
    rows = [policy, candidate(2, "receipt compiler"), candidate(3, "receipt"), candidate(4, "nothing")]
    results = []
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        decisions, conflicts = decide(spark, task(spark), rows)
        results.append(by_id(decisions))
        status = selection.status(decisions, selection.coverage(decisions, conflicts), conflicts).first()
    assert results[0] == results[1]
    assert results[0]["c001"] == ("INCLUDED", "INCLUDE_APPLICABLE_POLICY", 0)
    assert results[0]["c002"] == ("INCLUDED", "INCLUDE_CRITERION_COVERAGE", 1)
    assert results[0]["c003"][1] == "OMIT_SUFFICIENT_EVIDENCE"
    assert (status["evidence_status"], status["budget_status"]) == ("READY", "WITHIN_BUDGET")
    assert ledger.receipt_violations(decisions).count() == 0
    ablated = {r["candidate_id"]: (r["decision"], r["missing_required_terms"]) for r in ledger.ablate_all(decisions).collect()}
    assert ablated == {"c001": ("DENIED", []), "c002": ("DERIVED", ["receipt"])}


def test_conflict_and_duplicates(spark):
    adr = dict(provider="documents", kind="document", authority="adr", authority_evidence=["docs-adr"], symbol="S")
    rows = [candidate(1, "receipt", **adr), candidate(2, "receipt security", **adr), candidate(3, "security", source_hash="x", excerpt_hash="x"), candidate(4, "security", source_hash="x", excerpt_hash="x", path="src/longer-name.ts")]
    decisions, conflicts = decide(spark, task(spark, items=3), rows)
    found = conflicts.collect()
    assert [r["candidate_ids"] for r in found] == [["c001", "c002"]]
    got = by_id(decisions)
    assert got["c001"][0] == got["c002"][0] == "INCLUDED"
    status = selection.status(decisions, selection.coverage(decisions, conflicts), conflicts).first()
    assert status["evidence_status"] == "CONFLICT" and status["conflict_count"] == 1
    assert got["c003"][1] == got["c004"][1]  # an omitted representative passes its reason on


def model(rows, needs, limits):
    """Greedy cover written the plain way."""
    used, chosen, covered = [0, 0, 0], [], {c: set() for c in needs}
    left = list(range(len(rows)))

    def met(c):
        return needs[c] <= covered[c]

    while left:
        gain = {k: {(c, t) for c, ts in rows[k]["cover"].items() if not met(c) for t in ts - covered[c]} for k in left}
        best = sorted(left, key=lambda k: (-len(gain[k]), -rows[k]["score"], k))[0]
        if not gain[best]:
            break
        left.remove(best)
        cost = (1, rows[best]["bytes"], rows[best]["tokens"])
        if any(u + c > m for u, c, m in zip(used, cost, limits, strict=True)):
            continue
        used = [u + c for u, c in zip(used, cost, strict=True)]
        chosen.append(best)
        for c, t in gain[best]:
            covered[c].add(t)
    return chosen


@pytest.mark.parametrize("seed", range(25))
def test_greedy_equals_model(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    needs = {c: set(r.sample(words, 4)) for c in ("A", "B")}
    rows = []
    for _ in range(r.randrange(3, 25)):
        own = set(r.sample(words, r.randrange(0, 5)))
        rows.append({"cover": {c: needs[c] & own for c in needs if needs[c] & own}, "score": r.randrange(5), "bytes": r.randrange(1, 50), "tokens": r.randrange(1, 12)})
    limits = (r.randrange(1, 8), r.randrange(20, 200), r.randrange(5, 60))
    frame = pd.DataFrame([
        {"task_id": "T", "id": f"c{k}", "rank": k, "retained": False, "mandatory": False, "requested": False, "conflicted": False, "score": x["score"], "first_reason": "-", "excerpt_bytes": x["bytes"], "estimated_tokens": x["tokens"],
         "requirements": [{"id": c, "mode": "ALL", "terms": sorted(t), "minimum": len(t)} for c, t in needs.items()], "criterion_terms": [{"id": c, "terms": sorted(t)} for c, t in x["cover"].items()],
         "requested_terms": [], "required_sources": [], "group_paths": [f"p{k}"], "max_items": limits[0], "max_bytes": limits[1], "max_tokens": limits[2]}
        for k, x in enumerate(rows)
    ])
    out = selection.choose(frame)
    taken = out[out.status == "INCLUDED"].sort_values("position")
    assert [int(i[1:]) for i in taken.candidate_id] == model(rows, needs, limits)
    assert len(out) == len(rows)


def test_first_fit_skips_and_continues(spark):
    rows = spark.createDataFrame([("t", c, c, b, 1, 9, 8, 99) for c, b in (("a", 5), ("b", 4), ("c", 3))], "task_id string, id string, order string, excerpt_bytes long, estimated_tokens long, max_items int, max_bytes int, max_tokens int")
    assert selection.first_fit(rows).first()["ids"] == ["a", "c"]
