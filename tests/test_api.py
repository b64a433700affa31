"""The public verbs end to end on a small repository, and the stream of metrics."""

import json

from pyspark.sql import functions as F

from siftline.operators import candidates as cand
from siftline.plans import api
from siftline.streaming import metrics as stream


def test_prepare_expand_replay(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in {"AGENTS.md": "# Rules\nfollow the house policy", "docs/adr/0001-x.md": "# Receipt\nThe receipt compiler decides.", "src/compiler.ts": "export function compile() { return 'receipt'; }", "src/other.ts": "export const ledger = 1;", "package.json": '{"name":"demo"}'}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    package = api.prepare(spark, str(root), "compiler receipt", task_type="qa")
    envelope, of = package["envelope"], package["request"]
    assert api.verify(package) == []
    assert envelope["items"][0]["path"] == "AGENTS.md" and envelope["evidence_status"] == "READY"
    assert api.replay(package, package)["status"] == "IDENTICAL" and api.replay(package, None)["status"] == "UNREPLAYABLE"
    assert api.ablate(package, "none")["reason"] == "CANDIDATE_NOT_SELECTED"
    assert api.ablate(package, envelope["items"][0]["id"])["decision"] == "DENIED"
    seen = api.observe(spark, str(root))
    asked = {"previous_selection_digest": envelope["selection_digest"], "known_candidate_ids": [i["id"] for i in envelope["items"]], "requested_paths": ["src/other.ts"], "additional_budget": {"max_items": 2, "max_bytes": 1000, "max_estimated_tokens": 300}}
    widened = {**of, "task": {**of["task"], "hints": {**of["task"]["hints"], "paths": ["src"]}}}
    pool = api.gather(api.task_row(spark, widened), seen)
    after, decision = api.expand(spark, package, of, asked, pool)
    assert decision["status"] == "ALLOWED" and len(decision["additions"]) == 1
    assert any(i["path"] == "src/other.ts" for i in after["envelope"]["items"])
    _, stale = api.expand(spark, package, of, asked | {"previous_selection_digest": "x"}, pool)
    assert stale["reason_codes"] == ["STALE_PARENT"]
    broken = {**package, "envelope": {**envelope, "task_id": "other"}}
    assert "selection digest" in api.verify(broken)


def test_provider_caps(spark):
    tasks = spark.createDataFrame([("T", "g", "alpha", [("AC-1", "alpha", None)], [], [], [], ["docs/z.md"], 5, 5000, 1000)], api.scoring.TASKS)
    rows = [(f"docs/d{i:02d}.md", "document", "implementation_note", f"h{i}", "alpha text") for i in range(10)] + [("docs/z.md", "document", "implementation_note", "hz", "nothing")]
    made = cand.of_sources(tasks, spark.createDataFrame(rows, "path string, kind string, authority string, source_hash string, content string"), "documents", cap=3)
    got = made.orderBy("path").collect()
    assert [r["path"] for r in got] == ["docs/d00.md", "docs/d01.md", "docs/z.md"]
    assert all(r["truncation_reasons"] == ["PROVIDER_RESULT_LIMIT"] for r in got)


def test_stream(spark, tmp_path):
    record = {"task_id": "T", "arm": "A", "recorded_at": "2024-01-01T00:10:00Z", "input_tokens": 5}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(record) for _ in range(3)))
    totals = stream.windowed_totals(stream.read_records(spark, str(tmp_path / "in")))
    run = totals.writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("totals").select("record_count", F.col("input_tokens")).first() == (3, 15)
