"""Toxicity, packing, personal data and the pipeline."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import packing, pii, toxicity
from siftline.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    out = toxicity.classify(table(spark, sf, "documents"), labels).join(labels, "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out]
    caught = held[held.toxic == 1].predicted.mean()
    wrong = held[held.toxic == 0].predicted.mean()
    assert caught > 0.75 and wrong < 0.02


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "x" * 100_000, 3)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.classify(docs, labels).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.remove_toxic(docs, labels).columns == docs.columns
    assert toxicity.classify(docs.limit(0), labels.limit(0)).count() == 0
    rows = [(k, k, "you scum and trash" if k < 30 else "a fine day today", int(k < 30)) for k in range(90)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text_hash long, text string, toxic int"))
    assert toxicity.probability(model, "such SCUM, and trash") > 0.7 > toxicity.probability(model, "a fine day") > toxicity.probability(model, "") - 0.5
    few = toxicity.fit(spark.createDataFrame(rows[28:32], "doc_id long, text_hash long, text string, toxic int"))
    assert not few.weights.any() and abs(toxicity.probability(few, "x") - 0.5) < 1e-6


def test_toxicity_learns_from_long_texts_only(spark):
    """Labelled texts of 12,000 characters and more teach; ids that repeat are one sample; scores do not depend on pieces."""
    r = random.Random(9)
    filler = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    texts = {i: filler(2_000) + (" you filthy scum " if k % 2 else " a kindly neighbour ") * 20 for k, i in enumerate(ids)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] * 2 + [(9_000, filler(100_000) + " you filthy scum " * 30), (9_001, filler(100_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, k % 2) for k, i in enumerate(ids)] + [(70_000 + k, 0, 1) for k in range(50)], "doc_id long, quality int, toxic int")
    scores = {x["doc_id"]: x["score"] for x in toxicity.classify(docs, labels).collect()}
    assert all((scores[i] >= 0.7) == bool(k % 2) for k, i in enumerate(ids)) and scores[9_000] >= 0.7 > scores[9_001]


def test_toxicity_pieces(monkeypatch):
    text = "İ long text of many 語 words, " * 40
    whole = toxicity.distinct(text)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.array_equal(whole, toxicity.distinct(text))


def test_cuts():
    for n in [*range(1, 1500), 5_000, 10**6]:
        found = list(packing.cuts(n))
        assert sum(x for _, x in found) == n and all(0 < x <= 1024 for _, x in found)
        assert all(x <= packing.SHORT or x == 1024 // (1024 // x) for _, x in found)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    hard = [None, "", "  a  b\n\n c  ", "it's we'll I'VE 'sd  ''s", "x’s “q” …    z\x85y\x1c\x1dq", "日本語 text 😀 ñandú ½²³ a²b ٠", "<|endoftext|> a", "a<|endoftext|>b <|endoftext|><|endoftext|>é", "語<|endoftext|>x", "\t\tfoo\r\n\r\nbar   ", "á b c", "ªº µ × ÷ ǅ", "word " * 5000]
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(300).repartition(5)
    frame = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(hard)] + [(10_000, None)], "doc_id long, text string").union(docs)
    want = collections.defaultdict(list)
    for r in frame.collect():
        want[r["doc_id"]].append(np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    pieces, rows = collections.defaultdict(list), packing.pack(frame).collect()
    for r in rows:
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = total = 0
    for own_pieces in pieces.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * total
    got = collections.defaultdict(collections.Counter)
    for r in rows:
        got[r["doc_id"]][(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    assert set(got) == set(want)
    for doc, texts in want.items():
        expected = collections.Counter((s, n, zlib.crc32(t[4 * s : 4 * (s + n)]), len(t) // 4) for t in texts for s, n in packing.cuts(len(t) // 4))
        assert got[doc] == expected
    assert packing.pack(frame.limit(0)).count() == 0
    with_ids = packing.pack(frame.limit(20), ids=True).collect()
    assert all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)


def test_tokenizer_of_long_and_special_texts():
    """The cached path and the parts of long texts give the tokenizer's own ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing.public_tokenizer()
    r = random.Random(12)
    bits = ["<|endoftext|>", "<|endo", "  ", "\n", "\n\n ", " a", "é", "語", "'s", "12", "²", "_", "__ ", "٠", "\u200b", "\xa0", "\u3000", "!?", " ", "word", "\x1c", "\x85"]
    for k in range(3_000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text
        cut = list(packing.parts(text, k % 7 + 1))
        assert "".join(cut) == text
        assert [i for t in cut for i in own.encode(t, add_special_tokens=False).ids] == own.encode(text, add_special_tokens=False).ids, cut
    long = " ".join("".join(r.choice("abcdé 語") for _ in range(9)) for _ in range(150_000)) + "<|endoftext|>"
    assert len(long) > packing.PART and np.frombuffer(encode(long), "<u4").tolist() == own.encode(long, add_special_tokens=False).ids


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(c if k % 2 == 0 else 2 * c - 9 * (c > 4) for k, c in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]:
                out.append((m.start(), k, name, m.end()))
    return sorted(out)


def test_pii_equals_brute_force(spark):
    r = random.Random(3)
    texts = ["", None, "a@b.c@d.e_f@g.hh x@y", "a@b.com_foo@x.y.z", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "+1 (017) 555-7713 é +44 20 7946 0958", "4111 1111 1111 1111é4111-1111-1111-1111", "9" * 5000, "a" * 200_000, "1.2" * 3000, "a@" + ".b" * 3000, "😀 x@y.zz 😀 1.1.1.1"]
    texts += ["".join(r.choice("ab1239..@@+ -()é0") for _ in range(r.randrange(1, 60))) for _ in range(300)]
    texts += [f"please call me at +1 555 010 99{i}{i} now" for i in range(6)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, "", 1), (None, "q@r.st", 1), (90_000, "please call me at 555-0199-77 now", 1), (90_001, "but 555-0199-78 is no contact", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = {(x["doc_id"], x["base_sha256"]): x for x in pii.report(frame).collect()}
    for doc, text, _ in rows:
        spans = base(text or "")
        x = got[(doc, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest())]
        assert [x[f"n_{n}"] for n in PATTERNS] == [sum(s[2] == n for s in spans) for n in PATTERNS]
    assert next(x for k, x in got.items() if k[0] == 90_000)["spans"] == "context:18:29"
    assert next(x for k, x in got.items() if k[0] == 90_001)["spans"] == ""
    masked = {x["doc_id"]: x["text"] for x in pii.mask(frame).collect()}
    assert masked[90_000] == "please call me at <CONTEXT> now" and masked[None] == "<EMAIL>" and masked[1] is None and len(masked[8]) == 200_000
    assert pii.report(frame.limit(0)).count() == 0


def test_pii_patterns(spark):
    """Quoted keys, long words and long ids: what seeds teach is found; a pattern of mostly plain numbers is not trusted."""
    key = "k" * 34 + "1234567"
    rows = [f'contact = "+1 555 010 99{k}{k}" end' for k in range(5)] + [f'contact = "{key}" end', "word" * 30 + " dial at +44 20 7946 0958", "y" * 70 + f" contact: {key}0"]
    rows += [f"order number +1 555 020 99{k}{k} was" for k in range(4)] + [f"order number 88{k}77{k}99 was" for k in range(5)]
    out = [x["spans"] for x in pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert out[5] == f"context:11:{11 + len(key)}" and out[7] == f"context:80:{81 + len(key)}"
    assert all(x.startswith("phone") for x in out[:5]) and not any(out[12:])


def test_pii_clear_of_and_mask_equal_brute_force(spark):
    r = random.Random(6)
    cases = []
    for _ in range(200):
        base = sorted((a, r.randrange(4), a + r.randrange(1, 9)) for a in (r.randrange(200) for _ in range(r.randrange(90))))
        at, other = 0, []
        while at < 200:
            at += r.randrange(1, 9)
            other.append((at, 4, end := at + r.randrange(1, 6)))
            at = end
        cases.append(("".join(r.choice("ab é😀") for _ in range(230)), base, other))
    frame = spark.createDataFrame(cases, "t string, base array<struct<start:int,rank:int,end:int>>, other array<struct<start:int,rank:int,end:int>>")
    got = frame.select("t", "base", "other", pii.clear_of(F.col("base"), F.col("other")).alias("clear"), pii.masked(F.col("t"), F.col("base")).alias("m")).collect()
    for x in got:
        assert [tuple(c) for c in x["clear"]] == [tuple(c) for c in x["other"] if not any(b["start"] < c["end"] and c["start"] < b["end"] for b in x["base"])]
        out, at = [], 0
        for start, rank, end in x["base"]:
            if start >= at:
                out += [x["t"][at:start], f"<{pii.KINDS[rank].upper()}>"]
            at = max(at, end)
        assert x["m"] == "".join(out) + x["t"][at:]


def test_pii_of_long_texts(spark):
    """Megabytes of matches in one text; clashing column names; no rows."""
    texts = ["call bob at 12.1.1.1 or x1234567 " * 60_000, "1234567 " * 250_000, "a@b.cc," * 200_000, "x" * 10_000_000]
    began = time.time()
    frame = spark.createDataFrame([(k, t, "a", 7) for k, t in enumerate(texts)], "doc_id long, text string, span_list string, SPAN_ID int").repartition(4)
    out = {x["doc_id"]: x for x in pii.report(frame).collect()}
    assert (out[0]["n_ip"], out[2]["n_email"]) == (60_000, 200_000)
    kept = {x["doc_id"]: x for x in pii.mask(frame).collect()}
    assert kept[0]["text"].count("<IP>") == 60_000 and kept[2]["text"] == "<EMAIL>," * 200_000 and kept[3]["text"] == texts[3] and kept[1]["span_list"] == "a"
    assert time.time() - began < 120
    assert pii.mask(frame.limit(0)).count() == 0 and pii.mask(frame).columns == frame.columns


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    docs = table(spark, SF, "documents")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns
        seen = spark.createDataFrame(out.collect(), docs.schema)
    kept = {r["doc_id"]: r["text"] for r in seen.collect()}
    assert 0.7 * docs.count() < len(kept) < docs.count()
    assert all(not base(t) for t in kept.values())
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)


@pytest.mark.parametrize("module", ["siftline.plans.catalogue", "siftline.operators.selection"])
def test_nothing_else_imports_llm(module):
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "siftline"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
