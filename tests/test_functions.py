"""Column functions on the cases that tests elsewhere do not reach."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import digest, paths, screen, text
from siftline.operators import fts, graph, ledger, metrics, requests, search
from siftline.sources import repository


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.tokens(F.col("t"), True), t="ﬁx ㌀ A-1") == ["fix", "アパート", "a", "1"]
    assert one(spark, text.title(F.col("p"), F.col("t")), p="docs/a.b.md", t="﻿# Real  title ##\nx") == "Real title"
    assert one(spark, text.title(F.col("p"), F.col("t")), p="docs/a.b.md", t="none") == "a.b"
    e = one(spark, text.excerpt(F.col("t"), F.array(F.lit("key"))), t="1\n2\n3\n4\nkey " + "x" * 500 + "\n6\n7\n8")
    assert (e["start_line"], e["end_line"], e["truncated"], len(e["text"])) == (3, 5, True, 400)
    assert one(spark, text.bounded_excerpt(F.col("t"), 400, 5), t="éééé") == "éé"
    assert one(spark, text.bounded_excerpt(F.col("t")), t=" ") == text.EMPTY_EXCERPT
    assert "needle" in one(spark, text.relevant_excerpt(F.col("t"), F.array(F.lit("needle")), 400, 200), t="x " * 900 + "needle " + "y " * 900)
    assert one(spark, text.prioritised_terms([F.split("t", " "), F.array(F.lit("b"), F.lit("a"))], 3), t="z y") == ["a", "y", "z"]
    assert one(spark, text.normal_title(F.col("t")), t="  CAFÉ \t Policy ") == "café policy"


def test_digest(spark):
    assert digest.dumps({"b": None, "a": [1, 2.0, "é"]}) == '{"a":[1,2,"é"]}'
    assert digest.dumps({"b": None, "a": 1}, "explicit") == '{"b":null,"a":1}'
    assert list(__import__("json").loads(digest.dumps({"": 1, "\U0001f600": 2}))) == ["\U0001f600", ""]
    with pytest.raises(ValueError):
        digest.dumps({"a": 1 << 60})
    row = one(spark, digest.struct_hash(F.struct(F.col("t").alias("b"), F.lit(None).cast("string").alias("c"), F.lit("\x1f").alias("a"))), t="x")
    assert row == digest.json_hash({"a": "\x1f", "b": "x"})


def test_paths_and_screen(spark):
    assert one(spark, paths.modules(F.col("p")), p="docs/Core API/x.md") == ["api-core"]
    assert one(spark, paths.topics(F.col("p")), p="docs/Core/My-Page.v2.md") == ["my", "page", "v2"]
    assert one(spark, paths.ancestors(F.col("p")), p="a/b/c") == ["a/b", "a", ""]
    assert not one(spark, paths.is_safe(F.col("p")), p="a/../b") and one(spark, paths.is_safe(F.col("p")), p="a/b.c")
    assert one(spark, paths.is_excluded(F.col("p"), ["a/b"]), p="a/b/c") and not one(spark, paths.is_excluded(F.col("p"), ["a/b"]), p="a/bc")
    red = one(spark, screen.redact(F.col("t")), t="\x1b[31mBearer abc password=hunter22 sk_live_abc12345 id abcdefghijklmnopqrstuvwx1 Authorization: Basic dXNlcjpwYXNz")
    assert not any(w in red for w in ("hunter22", "sk_live", "uvwx1", "dXNl", "\x1b"))
    assert one(spark, screen.valid_cnpj(F.col("t")), t="11.222.333/0001-81") and not one(spark, screen.valid_cnpj(F.col("t")), t="11.222.333/0001-80")


def test_repository(spark, tmp_path):
    for name, body in {"README.md": "# Top\nx", "docs/a.md": "# A\nsee", "docs/leak.md": "AKIA" + "ABCDEFGHIJKLMNOP", "src/x.ts": "export function f() {}\n", ".env": "A=1", "bin.md": b"\xff\xfe", "src/y.py": "y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    files = repository.walk(spark, str(tmp_path), ["src/y.py"])
    assert sorted(r["path"] for r in files.select("path").collect()) == ["README.md", "bin.md", "docs/a.md", "docs/leak.md", "src/x.ts"]
    docs = repository.documents(files)
    assert [(r["path"], r["title"]) for r in docs.orderBy("path").collect()] == [("README.md", "Top"), ("docs/a.md", "A")]
    rest = repository.fallback(files, docs)
    assert [r["path"] for r in rest.collect()] == ["src/x.ts"]
    assert repository.omissions(files).first().asDict() == {"oversize": 0, "undecodable": 1, "sensitive": 1}
    assert repository.changed_between(files, files).count() == 0
    assert repository.hybrid(docs, rest).count() == 3
    nodes = graph.extract_nodes(rest)
    assert {(r["kind"], r["name"], r["exported"]) for r in nodes.collect()} == {("file", "x.ts", True), ("function", "f", True)}


def test_index(spark, tmp_path):
    rows = [("docs/b.md", "document", "adr", "Compiler receipt", "text"), ("docs/a.md", "document", "adr", "Compiler receipt", "text"), ("src/c.ts", "source_code", "source_code", "x", "compiler uses a receipt"), ("d", "document", "adr", "x", "compiler")]
    sources = fts.prepare_sources(spark.createDataFrame(rows, "path string, kind string, authority string, title string, content string"))
    index = fts.build(sources)
    assert [r["path"] for r in fts.search(index, "Compiler receipt").collect()] == ["docs/a.md", "docs/b.md", "src/c.ts"]
    assert fts.current(sources, str(tmp_path / "i")) is None
    of = fts.publish(sources, str(tmp_path / "i"))
    assert fts.current(sources, str(tmp_path / "i")) == of
    assert [r["path"] for r in fts.search(fts.read(spark, of), "receipt").collect()] == ["docs/a.md", "docs/b.md", "src/c.ts"]
    with pytest.raises(ValueError):
        fts.query("  ")
    with pytest.raises(ValueError):
        search.search(sources, "x", 0)


def test_requests():
    assert requests.allocate_budget("qa", soft_limit_tokens=7_000) == {"initial_tokens": 6_000, "soft_limit_tokens": 7_000, "hard_limit_tokens": 14_000}
    with pytest.raises(requests.RequestError):
        requests.allocate_budget("qa", soft_limit_tokens=1)
    of = requests.intent("Fix the login", "qa", paths=["b", "a"])
    assert of["task_id"] == requests.intent("Fix the login", "qa", paths=["b", "a"])["task_id"] and of["task_id"].startswith("AUTO-")
    plan = requests.request(of, {"repository_id": "r"})
    assert plan["task"]["hints"]["paths"] == ["a", "b"] and plan["budget"]["max_items"] == 32
    tier, budget = requests.expansion_budget(plan, {"used_items": 3, "used_bytes": 10, "used_tokens": 5, "max_items": 32, "max_bytes": 24_000, "max_estimated_tokens": 6_000}, {"max_items": 99, "max_bytes": 1, "max_estimated_tokens": 1})
    assert tier == "HARD" and budget["max_items"] == 67
    capped = requests.with_capsule(plan, {"budget": {"hard_limit_tokens": 100}, "documents": ["d.md"], "code_paths": ["x.ts#f"]})
    assert capped["required_sources"] == ["d.md", "x.ts"] and capped["budget"]["max_estimated_tokens"] == 100 and capped["task"]["hints"]["symbols"] == ["f"]


def test_ledger_and_metrics(spark):
    out = ledger.outcome(spark.createDataFrame([("T", "s", "r", ["b", "a", "a"], ["p"])], "task_id string, selection_digest string, run_id string, used_candidate_ids array<string>, touched_paths array<string>"))
    assert out.first()["used_candidate_ids"] == ["a", "b"] and out.first()["causality"] == "OBSERVATIONAL_ONLY"
    steps = spark.createDataFrame([("T", 1, "d0", "d1", ["a"]), ("T", 2, "d1", "d2", ["b"]), ("T", 3, "dX", "d3", ["a"])], "task_id string, sequence int, previous_selection_digest string, selection_digest string, additions array<string>")
    assert {(r["sequence"], r["rule"]) for r in ledger.expansion_violations(steps).collect()} == {(3, "chain"), (3, "addition_repeated")}
    record = spark.createDataFrame([("0.1", "T", "2024-01-01T00:00:00Z", "A", 1 << 52, *[None] * 10, "PASS", "PASS", "PASS", ["tool_calls"], None)] * 3, metrics.RECORD)
    assert {r["rule"] for r in metrics.violations(record).collect()} == {"estimated_absent"}
    with pytest.raises(Exception, match="too large"):
        metrics.totals(record).collect()
