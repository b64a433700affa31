"""Budgets, requests and capsules: small driver-side documents with their rules."""

from __future__ import annotations

import hashlib
import re
from typing import Any

from ..functions.digest import json_hash
from .search import query_terms

# Initial and soft token budgets by kind of task; hard is twice soft.
BUDGETS = {
    "small_ui": (3_000, 6_000), "small_code_fix": (4_000, 8_000), "module_feature": (6_000, 12_000), "integration": (8_000, 16_000),
    "qa": (6_000, 12_000), "orchestration": (10_000, 20_000),
}
TIER_ITEMS = {"initial": 32, "soft": 64, "hard": 128}
MAX_TIER_BYTES, MAX_REQUIRED_TERMS = 8 << 20, 64


class RequestError(ValueError):
    """A request that breaks its contract."""


def allocate_budget(task_type: str, **overrides: int) -> dict[str, int]:
    """initial_tokens, soft_limit_tokens and hard_limit_tokens of a kind of task."""
    if task_type not in BUDGETS:
        raise RequestError(f"unknown task type {task_type!r}")
    if unknown := set(overrides) - {"initial_tokens", "soft_limit_tokens", "hard_limit_tokens"}:
        raise RequestError(f"unknown budget fields {sorted(unknown)}")
    initial, soft = BUDGETS[task_type]
    out = {"initial_tokens": initial, "soft_limit_tokens": soft} | overrides
    out.setdefault("hard_limit_tokens", 2 * out["soft_limit_tokens"])
    if not 0 < out["initial_tokens"] <= out["soft_limit_tokens"] <= out["hard_limit_tokens"]:
        raise RequestError("budgets must not decrease from initial to hard")
    return out


def tiers(budget: dict[str, int]) -> dict[str, dict[str, int]]:
    """Item, byte and token limits of the three tiers."""
    return {
        t: {"max_items": n, "max_bytes": min(MAX_TIER_BYTES, 4 * budget[key]), "max_estimated_tokens": budget[key]}
        for (t, n), key in zip(TIER_ITEMS.items(), ("initial_tokens", "soft_limit_tokens", "hard_limit_tokens"), strict=True)
    }


def generated_task_id(value: dict[str, Any]) -> str:
    return "AUTO-" + json_hash(value)[7:23].upper()


def repository_id(name: str, path: str) -> str:
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "repository"
    return f"{slug}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def intent(goal: str, task_type: str = "small_code_fix", acceptance: list[str] | None = None, paths: list[str] | None = None, terms: list[str] | None = None, task_id: str | None = None, **more: Any) -> dict[str, Any]:
    """An intent from a goal in words; its id follows from what it says."""
    if not isinstance(goal, str) or not goal.strip():
        raise RequestError("a goal is needed")
    if acceptance is not None and len(set(acceptance)) < len(acceptance):
        raise RequestError("acceptance lists one text twice")
    body = {"schema_version": "0.3", "task_type": task_type, "goal": goal, "acceptance": acceptance or [goal], "query": goal}
    body |= {k: sorted(set(v), key=lambda t: t.encode("utf-16-be")) for k, v in (("paths", paths), ("terms", terms)) if v}
    return {"task_id": task_id or generated_task_id(body)} | body | {k: v for k, v in more.items() if v}


def request(of: dict[str, Any], snapshot: dict[str, Any]) -> dict[str, Any]:
    """A plan request from an intent: numbered criteria, sorted hints and three budget tiers."""
    criteria = of.get("acceptance_criteria") or of.get("acceptance") or [of["goal"]]
    sort = lambda key: sorted(set(of.get(key) or []))
    limits = tiers(allocate_budget(of["task_type"], **of.get("budget", {})))
    out = {
        "schema_version": "0.3",
        "task": {
            "task_id": of["task_id"], "task_type": of["task_type"], "goal": of["goal"], "query": of.get("query") or of["goal"],
            "acceptance_criteria": [{"id": f"AC-{n:03d}", "text": c} if isinstance(c, str) else {"id": f"AC-{n:03d}"} | c for n, c in enumerate(criteria, 1)],
            "hints": {"paths": sort("paths"), "symbols": sort("symbols"), "terms": sort("terms")},
        },
        "budget": limits["initial"], "progressive_budget": {"soft": limits["soft"], "hard": limits["hard"]},
        "required_sources": sort("required_sources"), "snapshot": snapshot,
    }
    return validate(out)


def validate(of: dict[str, Any]) -> dict[str, Any]:
    """The request itself, or RequestError for what is wrong with it."""
    criteria = of["task"]["acceptance_criteria"]
    ids = [c["id"] for c in criteria]
    if ids != sorted(set(ids)):
        raise RequestError("criteria must be unique and in order of id")
    if sum(len(c.get("required_terms") or []) for c in criteria) > MAX_REQUIRED_TERMS:
        raise RequestError("too many required terms")
    for name, values in (*of["task"]["hints"].items(), ("required_sources", of["required_sources"])):
        if values != sorted(set(values)):
            raise RequestError(f"{name} must be sorted and distinct")
    steps = [of["budget"], *(of.get("progressive_budget") or {}).values()]
    if any(a[k] > b[k] for a, b in zip(steps, steps[1:], strict=False) for k in a):
        raise RequestError("budgets must not decrease from tier to tier")
    if not query_terms(of["task"]["query"]):
        raise RequestError("the query has no terms")
    return of


def with_capsule(of: dict[str, Any], capsule: dict[str, Any]) -> dict[str, Any]:
    """The request within a capsule's limits: fewer tokens at most, its documents, code paths and references required."""
    cap = capsule["budget"]["hard_limit_tokens"]
    lower = lambda b: b | {"max_estimated_tokens": min(b["max_estimated_tokens"], cap)}
    needed = {*of["required_sources"], *capsule.get("documents", []), *(p.split("#")[0] for p in capsule.get("code_paths", [])), *capsule.get("references", [])}
    symbols = {*of["task"]["hints"]["symbols"], *(p.split("#", 1)[1] for p in capsule.get("code_paths", []) if "#" in p)}
    hints = of["task"]["hints"] | {"symbols": sorted(symbols)}
    return validate(of | {"budget": lower(of["budget"]), "progressive_budget": {k: lower(v) for k, v in of["progressive_budget"].items()}, "required_sources": sorted(needed), "task": of["task"] | {"hints": hints}, "capsule_digest": json_hash(capsule)})


def capsule(task_id: str, task_type: str, goal: str, worktree: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    """A task capsule with its budget."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", task_id):
        raise RequestError("task id is not safe")
    budget = allocate_budget(task_type, **more.pop("budget", {}))
    return {"schema_version": "0.1", "task_id": task_id, "task_type": task_type, "goal": goal, "budget": budget, "worktree": worktree} | more


# The fields of a compact handoff.
HANDOFF_NEEDED = ("schema_version", "task_id", "status", "changed_files", "tests", "risks", "next_unblocked")
HANDOFF_LISTS = ("changed_files", "interfaces_added", "decisions", "risks", "next_unblocked", "artifacts")
HANDOFF_TEXTS = ("commit", "metrics_ref")
HANDOFF_STATUS = ("PASS", "FAIL", "PARTIAL", "BLOCKED")


def validate_handoff(value: dict[str, Any]) -> list[str]:
    """What is wrong with a compact handoff; empty if nothing."""
    if not isinstance(value, dict):
        return ["not an object"]
    errors = [f"missing {k}" for k in HANDOFF_NEEDED if k not in value]
    errors += [f"unknown {k}" for k in value if k not in {*HANDOFF_NEEDED, *HANDOFF_LISTS, *HANDOFF_TEXTS}]
    errors += [f"{k} is not a list of texts" for k in HANDOFF_LISTS if k in value and not (isinstance(value[k], list) and all(isinstance(x, str) for x in value[k]))]
    errors += [f"{k} is not a text" for k in HANDOFF_TEXTS if k in value and not isinstance(value[k], str)]
    if value.get("schema_version", "0.1") != "0.1":
        errors.append("schema_version is not 0.1")
    if value.get("status", "PASS") not in HANDOFF_STATUS:
        errors.append("status is unknown")
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}", str(value.get("task_id", "x"))):
        errors.append("task_id is not safe")
    tests = value.get("tests", {"passed": 0, "failed": 0})
    if not isinstance(tests, dict):
        return [*errors, "tests is not an object"]
    errors += [f"tests lacks {k}" for k in ("passed", "failed") if k not in tests] + [f"unknown tests.{k}" for k in tests if k not in ("passed", "failed", "skipped")]
    return errors + [f"tests.{k} is not a count" for k, v in tests.items() if isinstance(v, bool) or not isinstance(v, int) or v < 0]


def expansion_budget(of: dict[str, Any], previous: dict[str, Any], extra: dict[str, int]) -> tuple[str | None, dict[str, int]]:
    """(tier, cumulative budget) of an expansion: soft while it suffices, then hard, never less than before."""
    used = {"max_items": previous["used_items"], "max_bytes": previous["used_bytes"], "max_estimated_tokens": previous["used_tokens"]}
    asked = {k: used[k] + (min(extra[k], 64) if k == "max_items" else extra[k]) for k in used}
    tier, ceiling = None, of["budget"]
    if of.get("progressive_budget"):
        soft = of["progressive_budget"]["soft"]
        tier = "HARD" if previous.get("tier") == "HARD" or any(asked[k] > soft[k] for k in asked) else "SOFT"
        ceiling = of["progressive_budget"][tier.lower()]
    return tier, {k: min(ceiling[k], max(previous[k], asked[k])) for k in asked}
