"""Benchmark decontamination against a brute-force version."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siftline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(FOLD))


def brute(docs, items, n=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(0, len(w) - n) + 1) if w else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if own := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [d.BLOCK, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK", block)
    r = random.Random(1)
    vocabulary = ["a", "B", "cé", "ÉD", "e-f", "10", "ñ", "z9"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randrange(0, 16))) for k in range(12)] + [(3, "A b"), (99, None), (50, "zz " * 12)]
    docs = [(k, text(r.randrange(0, 40)) + " " + (r.choice(items)[1] or "") + " " + text(3)) for k in range(40)]
    docs += [(1, None), (None, "zz " * 15), (5, ""), (5, ""), (7, "zz " * 2000)]
    left = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, k_id int, items string")
    right = spark.createDataFrame(items, "item_id long, text string")
    for limit in (d.BROADCAST_BYTES, 0):
        got = sorted((tuple(x) for x in d.contamination(left, right, broadcast_bytes=limit).collect()), key=str)
        assert got == brute(docs, items)


def test_removal_and_empty_tables(spark):
    passage = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, f"before {passage.upper()}, after!", "en"), (2, "clean text", "en")], "doc_id long, text string, k_text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [x["doc_id"] for x in d.remove_contaminated(docs, items).collect()] == [2]
    cut = {x["doc_id"]: x["text"] for x in d.remove_spans(docs.drop("k_text"), items).collect()}
    assert cut == {1: "before after!", 2: "clean text"}
    assert d.contamination(docs.limit(0), items).count() == 0
    assert d.contamination(docs, items.limit(0)).where(F.col("contaminated")).count() == 0


def test_spans_equal_brute_force_and_names_may_clash(spark):
    r = random.Random(2)
    text = lambda n: "".join(r.choice(["a ", "B, ", "cé ", "10-", "z9\n", "  "]) for _ in range(n))
    items = [(k, text(r.randrange(1, 14))) for k in range(8)]
    docs = [(k, text(r.randrange(0, 20)) + " " + r.choice(items)[1] + text(r.randrange(0, 9))) for k in range(60)] + [(61, None), (62, "")]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, hit_spans string, HIT_ID int")
    got = {x["doc_id"]: x["text"] for x in d.remove_spans(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert d.remove_spans(frame, spark.createDataFrame(items, "item_id long, text string")).columns == frame.columns
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] if w for i in range(max(0, len(w) - 10) + 1)}
    piece = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*")
    for k, t in docs:
        w = words(t)
        gone = {j for g in grams for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g for j in range(i, i + len(g))}
        first = piece.search(t or "")
        want = t if not gone else t[: first.start()] + "".join(p for i, p in enumerate(piece.findall(t)) if i not in gone)
        assert got[k] == want


def test_long_text(spark):
    """Ten megabytes of words with hits all over, in time and without its windows in memory at once."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven x " * 180_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string")
    began = time.time()
    x = d.contamination(docs, items).first()
    assert (x["n_words"], x["n_hit"]) == (2_160_000, 1_800_000)
    assert d.remove_spans(docs, items).first()["text"] == "eleven x " * 180_000
    assert time.time() - began < 90
