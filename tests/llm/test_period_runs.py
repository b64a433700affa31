"""Runs against a brute-force search, and the number of comparisons against the length."""

import hashlib
import itertools
import random
import zlib

import pytest

from siftline.llm import period_runs, queries

SF = "/root/testdata/sf0.01"


def brute(x, least):
    """Every maximal stretch of every period; of those at one place the least period."""
    best = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("letters", "longest"), [("ab", 11), ("abc", 7), ("abcd", 5)])
def test_all_short_sequences(letters, longest):
    for n in range(longest + 1):
        for x in itertools.product(letters, repeat=n):
            assert period_runs.runs(list(x), 1) == brute(x, 1), x


def test_random_sequences():
    r = random.Random(1)
    for _ in range(1_500):
        n, k = r.randrange(1, 90), r.choice([1, 2, 2, 3, 5])
        x = [r.choice("abcde"[:k]) for _ in range(n)]
        if r.random() < 0.5:
            x = (x[: r.randrange(1, 12)] * n)[:n]
            for _ in range(r.randrange(3)):
                x[r.randrange(n)] = r.choice("abc")
        least = r.choice([1, 4, 12])
        assert period_runs.runs(x, least) == brute(x, least), x


def families(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    yield b[:n]  # Fibonacci
    yield "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    yield "a" * n
    yield "a" * (n - 1) + "b"
    yield "b" + "a" * (n - 1)
    m = int(n**0.5)
    yield ("a" * m + "b") * m
    yield "".join("a" * i + "b" for i in range(m))
    yield "".join("a" * i + "b" for i in range(m, 0, -1))
    yield ("a" * (n // 4) + "b" + "a" * (n // 4) + "c") * 2
    x, r = "ab", random.Random(5)
    while len(x) < n:
        x = x + x[-r.randrange(1, len(x) + 1) :] + r.choice(["", "a", "b"])
    yield x[:n]


def test_comparisons_grow_with_the_length_only():
    class Counted(str):
        made = 0

    def counting(name):
        def of(self, other):
            Counted.made += 1
            return getattr(str, name)(self, other)

        return of

    for name in ("__eq__", "__ne__", "__lt__", "__gt__"):
        setattr(Counted, name, counting(name))
    for n in (1_000, 8_000, 40_000):
        for text in families(n):
            Counted.made = 0
            period_runs.runs([Counted(c) for c in text], 1)
            assert Counted.made <= 20 * len(text)


def expected(doc_id, text):
    words = period_runs.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, n_, q in found for i in range(s + q, s + n_)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_against_brute_force(spark, tmp_path):
    line = "same words in one line again and again "
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("abcd") if k % 3 else r.choice(["x", "y"]) for _ in range(r.randrange(200))), 1) for k in range(200)]
    rows += [(None, line * 20, 1), (900, None, 1), (901, "", 2), (902, line * 20, 3), (902, line * 20, 3), (903, "  a b " * 9, 4), (904, "word", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.QUERIES["op13_period_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=str)
    assert period_runs.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_the_given_table(spark):
    from siftline.sources.tables import table

    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_period_runs"](spark, SF).collect()}
    assert len(got) == docs.count() and any(r["n_runs"] for r in got.values())
    for doc_id, text in docs.where("doc_id % 9 = 0 AND char_length(text) < 6000").select("doc_id", "text").collect():
        assert tuple(got[doc_id]) == expected(doc_id, text)


def test_spans_and_collapsed_texts(spark):
    df = spark.createDataFrame([("k", "go on and on and on and on and on and on and on stop"), ("n", None), ("e", "")], "key string, text string")
    out = {r["key"]: r for r in period_runs.collapse(period_runs.mark(df)).collect()}
    span = out["k"]["runs"][0]
    assert (span["start"], span["length"], span["period"]) == (1, 14, 2) or span["period"] == 2
    assert df.first()["text"][span["first_char"] : span["end_char"]].split()[:3] == ["on", "and", "on"]
    assert out["k"]["collapsed"] == "go on and stop" and out["n"]["collapsed"] == out["e"]["collapsed"] == "" and out["n"]["runs"] == []
    with pytest.raises(ValueError, match="already"):
        period_runs.mark(df.withColumn("Runs", df["key"]))


def test_long_text():
    r = random.Random(4)
    words = [r.choice("abcdefgh") for _ in range(40_000)]
    x = words + ["z", "y", "x"] * 60_000 + words
    assert (40_000, 180_000, 3) in period_runs.runs(x)
