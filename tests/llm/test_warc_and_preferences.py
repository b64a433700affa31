"""WARC derivatives by round trip, preference pairs against a brute-force version."""

import gzip
import random

import duckdb
import pandas as pd

from siftline.llm import oracles
from siftline.llm import preferences as p
from siftline.llm import warc_derive as w


def test_parse_and_links():
    source = w.response("http://a b/", b"<title> T &amp; U </title><nav><a href='/x?a=1&amp;b=2'>go</a></nav><p>One  two", "2024-01-01T00:00:00Z")
    other = w.Record([("WARC-Type", "request"), ("Content-Length", "2")], b"hi")
    plain = source.to_bytes() + other.to_bytes()
    for data in (plain, gzip.compress(source.to_bytes()) + gzip.compress(other.to_bytes())):
        records, broken = w.parse(data)
        assert broken == 0 and [r.get("warc-type") for r in records] == ["response", "request"] and records[0].to_bytes() == source.to_bytes()
    assert w.parse(plain[:-10])[1] == 1 and w.parse(b"") == ([], 0) and w.parse(b"junk")[1] == 1
    assert w.derive(other) is None
    metadata, conversion = w.derive(source)
    assert conversion.block == b"go\nOne two" and conversion.get("WARC-Refers-To") == metadata.get("WARC-Refers-To") == source.get("WARC-Record-ID")
    assert conversion.get("WARC-Block-Digest") == w.digest(conversion.block) and conversion.get("WARC-Target-URI") == "http://a%20b/"
    assert b'"url":"/x?a=1&b=2"' in metadata.block and b'"title":"T & U"' in metadata.block
    assert w.parse(metadata.to_bytes() + conversion.to_bytes())[0][1].block == conversion.block


def test_pages(spark):
    rows = [(1, "http://x/", "<p>a</p>", 1), (None, None, None, 1), (1, "http://x/", "<p>a</p>", 1), (2, "u", "", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    out = w.derive_pages(frame, records=True).collect()
    assert len(out) == 4 and all(r["digests_hold"] and r["refers_to"] == r["response_id"] for r in out)
    assert len({r["response_id"] for r in out}) == 3
    for r in out:
        records, broken = w.parse(bytes(r["metadata"]) + bytes(r["conversion"]))
        assert broken == 0 and [x.get("WARC-Type") for x in records] == ["metadata", "conversion"]
    assert w.derive_pages(frame.limit(0)).count() == 0


def test_pairs_equal_brute_force(spark):
    r = random.Random(6)
    talks = {k: [(r.choice(["user", "assistant"]), r.choice(["a", "bé", ""])) for _ in range(r.randrange(1, 7))] for k in range(41)}
    for k in range(0, 40, 4):
        talks[k + 1] = talks[k][: r.randrange(len(talks[k]) + 1)] + talks[k + 1]
    rows = [(k, n, role, text, "x") for k, turns in talks.items() for n, (role, text) in enumerate(turns)] + [(None, 1, "user", "lost", "x"), (3, None, "user", "lost", "x"), (90, 0, None, None, "x")]
    talks[90] = [("", "")]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    got = {x["pair_id"]: x for x in p.format_table(frame).collect()}
    render = lambda turns: "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in turns)
    assert set(got) == {k // 2 for k in talks}
    for k, x in got.items():
        a, b = talks.get(2 * k, []), talks.get(2 * k + 1, [])
        n = next((i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1]), len(a))
        assert (x["n_common"], x["prompt"], x["chosen_completion"], x["rejected_completion"]) == (n, render(a[:n]), render(a[n:]), render(b[n:]))
        spans = [tuple(map(int, s.split(":"))) for s in x["chosen_loss"].split(",") if s]
        assert [x["chosen_completion"][i:j] for i, j in spans] == [f"{t}<|end|>\n" for role, t in a[n:] if role == "assistant"]
    assert p.format_table(frame.limit(0)).count() == 0


def test_marks_in_turns(spark):
    parts = ["<|", "|>", "<|end|>\n", "assistant", "\\", "<", ">", "|", "\n", "x"]
    r = random.Random(8)
    turns = [(k, n, "".join(r.choices(parts, k=r.randrange(4))), "".join(r.choices(parts, k=r.randrange(9)))) for k in range(60) for n in range(r.randrange(1, 5))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for x in p.format_table(frame).collect():
        for side, completion in ((0, "chosen_completion"), (1, "rejected_completion")):
            assert p.parse(x["prompt"] + x[completion]) == [(a, b) for k, _, a, b in turns if k == 2 * x["pair_id"] + side]


def test_sql_and_long_conversations(spark):
    r = random.Random(9)
    turns = [(k, n, r.choice(["user", "assistant", None, "a|>"]), r.choice(["a", "é<|end|>", None, "\\<\\|"])) for k in range(-8, 70) for n in range(r.randrange(1, 6))]
    turns += [(100, n, ("user", "assistant")[n % 2], "word " * (n % 5)) for n in range(20_000)] + [(101, n, ("user", "assistant")[n % 2], "word " * (n % 5) + "!" * (n > 9)) for n in range(20_000)]
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"])  # noqa: F841 (read by the SQL)
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = p.format_table(frame)
    want = duckdb.sql(oracles.OP8)
    assert made.columns and sorted(made.columns) == sorted(want.columns)
    got, want = made.collect(), {x[0]: dict(zip(want.columns, x, strict=True)) for x in want.fetchall()}
    assert len(got) == len(want) and all(x.asDict() == want[x["pair_id"]] for x in got)
    long = next(x for x in got if x["pair_id"] == 50)
    assert long["n_common"] == 10 and long["chosen_loss"].count(":") == 9_995


def test_token_masks(spark):
    rows = [(0, 0, "user", "hello there"), (0, 1, "assistant", "first answer"), (0, 2, "user", "and"), (0, 3, "assistant", "more é"), (1, 0, "user", "hello there"), (1, 1, "assistant", ""), (4, 0, None, None)]
    made = p.format_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), listed=False)
    by_letter = lambda: lambda text: b"".join(ord(c).to_bytes(4, "little") for c in text)
    sides = {(x["pair_id"], x["side"]): x for x in p.token_masks(made, by_letter).collect()}
    seen = lambda x: "".join(chr(i) for i in x["labels"] if i != p.IGNORED)
    assert {k: seen(x) for k, x in sides.items()} == {(0, "chosen"): "first answer<|end|>\nmore é<|end|>\n", (0, "rejected"): "<|end|>\n", (2, "chosen"): "", (2, "rejected"): ""}
    assert all(a in (b, p.IGNORED) for x in sides.values() for a, b in zip(x["labels"], x["input_ids"], strict=True))
    assert "".join(map(chr, sides[0, "rejected"]["input_ids"])) == "<|user|>\nhello there<|end|>\n<|assistant|>\n<|end|>\n"
    whole = p.token_masks(made).where("pair_id = 0 AND side = 'chosen'").first()
    assert len(whole["input_ids"]) == len(whole["labels"]) and 0 < sum(i != p.IGNORED for i in whole["labels"]) < len(whole["labels"])
