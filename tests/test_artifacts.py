"""Stored packages, JSON rules, ledgers that refuse what does not hold, and replay of a stored package."""

import json

import pytest

from siftline.operators import requests
from siftline.operators.requests import RequestError
from siftline.plans import api, artifacts


def repository(root):
    for name, body in {"AGENTS.md": "# Rules\nhouse policy", "docs/a.md": "# Receipt\nThe receipt compiler decides.", "src/compiler.ts": "export function compile() { return 'receipt'; }"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_package_round_trip_and_replay(spark, tmp_path):
    root = tmp_path / "repo"
    repository(root)
    package = api.prepare(spark, str(root), "compiler receipt")
    path = artifacts.write_package(spark, str(tmp_path / "out"), package)
    again = artifacts.read_package(spark, path)
    assert again["envelope"] == json.loads(json.dumps(package["envelope"])) and again["request"]["task"]["task_type"] == "small_code_fix"
    assert artifacts.compact(package)["decision_counts"]["INCLUDED"] == len(package["envelope"]["items"])
    assert "excerpt" not in artifacts.compact(package)["items"][0]
    same = artifacts.replayed(spark, again, str(root))
    assert (same["status"], same["freshness"]) == ("IDENTICAL", "MATCHED")
    (root / "docs" / "a.md").write_text("# Receipt\nThe receipt compiler changed.")
    moved = artifacts.replayed(spark, again, str(root))
    assert (moved["status"], moved["freshness"]) == ("DRIFTED", "CHANGED")
    stored = json.loads((tmp_path / "out").rglob("*.json").__next__().read_text())
    stored["envelope"]["items"][0]["score"] += 1
    artifacts.write_text(spark, path, json.dumps(stored))
    with pytest.raises(RequestError, match="digest"):
        artifacts.read_package(spark, path)


def test_json_rules():
    assert artifacts.parse_json(b'{"a":[1,2.5,null]}') == {"a": [1, 2.5, None]}
    for bad in (b'{"a":1,"a":2}', b"[NaN]", b"\xff", b"{", b'{"__proto__":1}', b"[" * 70 + b"]" * 70):
        with pytest.raises(RequestError):
            artifacts.parse_json(bad)


def test_ledger_append(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    artifacts.append_records(spark, folder, [{"task_id": "T", "sequence": 1, "body": "a"}, {"task_id": "T", "sequence": 2, "body": "b"}])
    rows = artifacts.append_records(spark, folder, [{"task_id": "T", "sequence": 3, "body": "c"}]).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == [1, 2, 3] and rows[2]["previous_record_digest"] == rows[1]["record_digest"]
    for wrong in ([{"task_id": "T", "sequence": 5, "body": "gap"}], [{"task_id": "T", "sequence": 2, "body": "again"}]):
        with pytest.raises(RequestError):
            artifacts.append_records(spark, folder, wrong)
    file = next((tmp_path / "ledger").glob("*.jsonl"))
    artifacts.write_text(spark, str(file), file.read_text().replace('"a"', '"z"').replace('"c"', '"z"'))
    with pytest.raises(RequestError):
        artifacts.append_records(spark, folder, [{"task_id": "T", "sequence": 4, "body": "d"}])


def test_handoff_and_intent():
    good = {"schema_version": "0.1", "task_id": "T-1", "status": "PASS", "changed_files": ["a"], "tests": {"passed": 1, "failed": 0}, "risks": [], "next_unblocked": []}
    assert requests.validate_handoff(good) == []
    for wrong in ({"status": "OK"}, {"tests": {"passed": -1, "failed": 0}}, {"tests": {"passed": 1}}, {"risks": "none"}, {"summary": "x"}, {"schema_version": "1"}, {"task_id": "a/b"}):
        assert len(requests.validate_handoff(good | wrong)) == 1, wrong
    assert "missing tests" in requests.validate_handoff({k: v for k, v in good.items() if k != "tests"})
    made = requests.intent("Do it", paths=["b", "a"])
    assert made["task_type"] == "small_code_fix" and made["acceptance"] == ["Do it"] and made["paths"] == ["a", "b"]
    assert made["task_id"].startswith("AUTO-") and made["task_id"][5:] == made["task_id"][5:].upper() and len(made["task_id"]) == 21
