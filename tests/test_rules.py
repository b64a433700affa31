"""Schema rules, candidates within their caps, scopes, metric lines and normalised words against plain versions."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.functions import screen, text
from siftline.operators import candidates as cand
from siftline.operators import graph, metrics, schema, scoring

RULES = {
    "type": "object", "required": ["a"], "additionalProperties": False,
    "properties": {
        "a": {"type": "string", "minLength": 2, "maxLength": 4, "maxUtf8Bytes": 5, "pattern": "^[a-zé]+$"}, "b": {"type": "integer", "minimum": -1, "maximum": 3}, "c": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "object", "required": ["d"], "properties": {"d": {"enum": [1, "x", True, None]}}}},
        "e": {"const": 2}, "f": {"type": "boolean"}, "g": {"type": "number"},
    },
}


def plain(value, rules, path="$"):
    """The same rules over Python values."""
    out = []
    same = lambda a, b: type(a) is type(b) and a == b or (isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)
    if "const" in rules and not same(value, rules["const"]):
        out.append((path, "const"))
    if "enum" in rules and not any(same(value, e) for e in rules["enum"]):
        out.append((path, "enum"))
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool), "number": number, "integer": number and float(value).is_integer() and abs(value) < 2**53}
    if "type" in rules and not fits[rules["type"]]:
        return [*out, (path, "type")]
    if isinstance(value, str):
        tests = {"minLength": len(value) < rules.get("minLength", 0), "maxLength": len(value) > rules.get("maxLength", 99), "maxUtf8Bytes": len(value.encode()) > rules.get("maxUtf8Bytes", 99), "pattern": not __import__("re").search(rules.get("pattern", ""), value)}
        out += [(path, k) for k, bad in tests.items() if bad]
    if number:
        out += [(path, k) for k, bad in {"minimum": value < rules.get("minimum", -1e99), "maximum": value > rules.get("maximum", 1e99)}.items() if bad]
    if isinstance(value, list):
        out += [(path, k) for k, bad in {"minItems": len(value) < rules.get("minItems", 0), "maxItems": len(value) > rules.get("maxItems", 99), "uniqueItems": rules.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value)}.items() if bad]
        out += [x for k, v in enumerate(value) for x in plain(v, rules.get("items", {}), f"{path}[{k}]")]
    if isinstance(value, dict):
        out += [(f"{path}.{k}", "required") for k in rules.get("required", []) if k not in value]
        for k, v in value.items():
            if k in rules.get("properties", {}):
                out += plain(v, rules["properties"][k], f"{path}.{k}")
            elif rules.get("additionalProperties") is False:
                out.append((f"{path}.{k}", "additionalProperties"))
    return out


def test_schema_rules_against_plain_ones(spark):
    r = random.Random(3)
    leaf = lambda: r.choice(["ab", "a", "abcde", "éé", "ééé", "A", "", 0, 1, 2, 3.0, 3.5, -2, 4, True, False, None, "x", 2**60, [], {}])

    def some(depth):
        if depth and r.random() < 0.8:
            return {k: some(depth - 1) if k != "c" else [{"d": leaf()} if r.random() < 0.8 else leaf() for _ in range(r.randrange(4))] for k in r.sample(["a", "b", "c", "e", "f", "g", "h"], r.randrange(8))}
        return leaf()

    values = [some(2) for _ in range(400)]
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in enumerate(values)] + [(-1, "{"), (-2, '{"a":1,"a":2}'), (-3, None)], "k long, body string")
    got = sorted(tuple(x) for x in schema.violations(rows, "body", RULES, ["k"]).collect())
    assert got == sorted([(k, p, rule) for k, v in enumerate(values) for p, rule in plain(v, RULES)] + [(k, "$", "json") for k in (-1, -2, -3)])
    with pytest.raises(ValueError, match="constant"):
        schema.violations(rows, "body", {"const": [1]}, ["k"])


def test_stable_characters():
    every = [chr(c) for a, b in text.STABLE for c in range(a, b + 1)]
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in every)
    r = random.Random(1)
    for _ in range(300):
        s = "".join(r.choice(every) for _ in range(2_000))
        assert unicodedata.normalize("NFKC", s) == s


def test_words_in_compatibility_forms(spark):
    texts = ["plain words", "ﬁle ＡＢＣ Ⅳ ½ ｶﾞ", "été", "über straße", None, "ſ ™"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", text.tokens(F.col("t")).alias("w")).orderBy("k").collect()
    import regex

    assert [r["w"] for r in rows] == [regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFKC", t or "").lower()) for t in texts]


def request(spark, *rows):
    return spark.createDataFrame([(t, "g", q, [("AC-001", c, None)], hints, [], [], req, 8, 60_000, 15_000) for t, q, c, hints, req in rows], scoring.TASKS)


@pytest.mark.parametrize("provider", ["documents", "filesystem"])
def test_caps_keep_the_first_of_the_order(spark, provider):
    """Candidates within every cap against looking at each source for each task."""
    r = random.Random(provider)
    words = [f"w{k}" for k in range(12)]
    sources = []
    for k in range(120):
        body = " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))
        if k % 10 == 0:  # longer than an excerpt: what shows depends on the task
            body = "\n".join(r.choice(["-", "..", *words[:4]]) for _ in range(900))
        sources.append((f"d{r.randrange(4)}/f{k:03d}.md", "code", "policy" if k % 17 == 3 else "source_code", body, f"h{k}"))
    rows = spark.createDataFrame(sources, "path string, kind string, authority string, content string, source_hash string")
    asked = request(spark, ("A", "w1 w2", "w3", ["d1"], ["d0/none.md", sources[5][0]]), ("B", "w9", "w9", [], []), ("C", "zzz", "yyy", ["d2"], [sources[7][0]]), ("D", "ｗ4 w5 w6 w7 w8", "w0", [], []))
    whole = {(x["task_id"], x["path"]): x for x in cand.of_sources(asked, rows, provider, cap=500).collect()}
    for cap in (3, 20):
        got = cand.of_sources(asked, rows, provider, cap=cap, collection_limited=True).collect()
        for t in "ABCD":
            needs = {"A": [sources[5][0]], "C": [sources[7][0]]}.get(t, [])
            mine = sorted((x for (task, _), x in whole.items() if task == t), key=lambda x: (x["path"] not in needs, x["authority"] != "policy", x["path"] if provider == "documents" else x["id"]))
            assert {x["id"] for x in got if x["task_id"] == t} == {x["id"] for x in mine[:cap]}, (t, cap)
            for x in got:
                if x["task_id"] == t:
                    assert ("PROVIDER_RESULT_LIMIT" in x["truncation_reasons"]) == (len(mine) > cap) and "SOURCE_COLLECTION_LIMIT" in x["truncation_reasons"]


def test_innermost_scopes(spark):
    r = random.Random(5)
    scopes = [(f"p{r.randrange(3)}", f"s{k:03d}", a := r.randrange(0, 500), a + r.randrange(0, 300), r.sample(["x", "y", "z"], r.randrange(3))) for k in range(150)]
    calls = list({(f"p{r.randrange(4)}", r.randrange(0, 800), r.choice("xyz")) for _ in range(400)})
    found = graph.shadowed(spark.createDataFrame(calls, "path string, place long, identifier string"), spark.createDataFrame(scopes, "path string, scope_id string, from_place long, to_place long, names array<string>"))
    for x in found.collect():
        around = [(a, -b, s) for p, s, a, b, names in scopes if p == x["path"] and x["identifier"] in names and a <= x["place"] < b]
        assert x["scope_id"] == (max(around)[2] if around else None) and x["lexically_shadowed"] == bool(around)
    assert found.count() == len(calls)


def test_graph_digest_counts_order_and_repeats(spark):
    files = spark.createDataFrame([("a", "h"), ("b", "h")], "path string, source_hash string")
    nodes = spark.createDataFrame([("a", 1, 1, "file", "n1", "h")], "path string, start_line int, start_column int, kind string, node_id string, source_hash string")
    edges = spark.createDataFrame([("calls", "n1", None, "f", "e1"), ("calls", "n1", None, "f", "e1")], "kind string, from_id string, to_id string, target string, edge_id string")
    whole = graph.summary(files, nodes, edges).first()
    assert (whole["files"], whole["nodes"], whole["edges"]) == (2, 1, 2)
    assert graph.summary(files.orderBy(F.desc("path")), nodes, edges).first() == whole
    assert graph.summary(files, nodes, edges.distinct()).first()["graph_digest"] != whole["graph_digest"]
    assert graph.summary(files, nodes, edges.limit(0)).first()["graph_digest"] != graph.summary(files.limit(1), nodes, edges.limit(0)).first()["graph_digest"]


def test_metric_lines(spark):
    ok = {"schema_version": "0.1", "task_id": "T-1", "recorded_at": "2024-01-01T00:00:00Z", "input_tokens": 3}
    lines = [json.dumps(ok), "", json.dumps(ok | {"input_tokens": -1}), "no json", json.dumps(ok | {"arm": "C", "duration_ms": 2**53})]
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate(lines)], "file string, line long, value string")
    good, wrong = metrics.scan(rows)
    assert [r["line"] for r in good.collect()] == [0]
    assert {(r["line"], r["path"], r["rule"]) for r in wrong.collect()} == {(2, "$.input_tokens", "minimum"), (3, "$", "json"), (4, "$.arm", "enum"), (4, "$.duration_ms", "type"), (4, "$.duration_ms", "maximum")} - {(4, "$.duration_ms", "maximum")}
    assert {r["rule"] for r in metrics.scan(rows, 3)[1].where("line IS NULL").collect()} == {"capacity"}


def test_labelled_values(spark):
    cases = {
        "password: hunter2hunter2": True, "password: short": False, "Password = abcdefghijklmnop": True, "api key: abcdefghijklmnop": False, "api-key: 'abcdefghijklmnopqrst'": True, "| password | a1b2c3d4e5f6 |": True, "password: | a1b2c3d4e5f6": True,
        "client email: a@b.co": True, "client email: a b@c.d e": False, "customer ssn: 123-45-6789": True, "client phone: 1234567": False, "access_token:\n a1b2c3d4e5f6": False, "password: \"a\\\"1234567890\"": True, "client tax id: 12;345678901": False,
        "x" * 50: False, "password: no " * 1_025: True, "CNPJ: 11.222.333/0001-81": True, "CNPJ: 11.222.333/0001-82": False, "refresh token: **`a1b2c3d4e5f6`**": True, None: False,
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k long, t string")
    got = [r["s"] for r in rows.select("k", screen.is_sensitive(F.coalesce("t", F.lit(""))).alias("s")).orderBy("k").collect()]
    assert dict(zip(cases, got, strict=True)) == cases


def test_metric_lines_are_checked_once_and_each_for_itself(spark):
    """Lines that share a number, or have none, do not stand or fall together; what holds is found without a join."""
    ok = json.dumps({"schema_version": "0.1", "task_id": "T-1", "recorded_at": "2024-01-01T00:00:00Z", "input_tokens": 3})
    rows = spark.createDataFrame([("f", 1, ok), ("f", 1, "no json"), ("f", None, "no json"), ("f", None, ok), (None, 2, "{}")], "file string, line long, value string")
    good, wrong = metrics.scan(rows)
    assert sorted((r["line"] or 0, r["input_tokens"]) for r in good.collect()) == [(0, 3), (1, 3)]
    assert {(r["file"], r["line"], r["rule"]) for r in wrong.collect()} == {("f", 1, "json"), ("f", None, "json"), (None, 2, "required")}
    assert "Join" not in good._jdf.queryExecution().optimizedPlan().toString()
