"""Findings of round 3: queries and steps that differed from their SQL or grew faster than their input."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import candidates, fts, graph, ordered
from siftline.plans import catalogue, corpus


def equal_to_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return sorted(map(tuple, catalogue.QUERIES[name](spark, str(folder)).collect())) == sorted(con.execute(catalogue.ORACLES[name]).fetchall())


def documents(spark, folder, texts):
    rows = [(k, t, ("en", "de", "fr", "es")[k % 4], f"src{k % 3}", len(t or "")) for k, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def test_a_title_is_cut_before_its_letters_are_replaced(spark, tmp_path):
    documents(spark, tmp_path, [(1, "st " * 19 + "ab the x"), (2, "st the"), (3, "the first st")])
    assert equal_to_sql(spark, tmp_path, "search_compatibility")


def test_blocks_are_hashed_where_they_lie(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    marks = [hashlib.sha256(bytes([k])).digest() for k in range(11)]
    batches = [pa.RecordBatch.from_pydict({"rank": np.arange(a, b), "hash": marks[a:b]}) for a, b in ((1, 6), (6, 11))]
    got = [x for b in ordered._pieces(iter(batches)) for x in b.to_pylist()]
    assert [(x["block"], x["first"], len(x["text"])) for x in got] == [(0, 1, 192), (1, 4, 64), (2, 8, 192)]
    assert got[1]["text"] == hashlib.sha256(b"".join(marks[4:8]).hex().encode()).hexdigest()


def test_digest_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(f'{{"a":{k}}}') for k in range(40)]
    for _ in range(2):
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    assert len(level) == 3
    assert ordered.of_rows(spark.range(40).toDF("a"), ["a"], ["a"], levels=2) == (40, "sha256:" + sha(f"40\n{min(level)}"))


def test_scopes_of_any_length(spark):
    scopes = spark.createDataFrame([("p", "wide", 0, 1 << 40, ["x"]), ("p", "near", (1 << 39) - 3, (1 << 39) + 5, ["x"])], "path string, scope_id string, from_place long, to_place long, names array<string>")
    calls = spark.createDataFrame([("p", 1 << 38, "x"), ("p", 1 << 39, "x"), ("p", 1 << 41, "x")], "path string, place long, identifier string")
    assert sorted((r["place"], r["scope_id"]) for r in graph.shadowed(calls, scopes).collect()) == [(1 << 38, "wide"), (1 << 39, "near"), (1 << 41, None)]
    assert graph.shadowed(calls, scopes.limit(0)).where("lexically_shadowed").count() == 0


def test_terms_are_counted_as_whole_words(spark):
    values = ["the other the THE", "breathe the-the_the the1 1the thé ñthe thé", "𝒶the the𝒶 the", "ｔhe ﬆ", "", None, "thethe the"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(F.size(F.filter(text.tokens(F.col("t")), lambda w: w == "the")), text.term_uses(text.plain(F.col("t")), "the"))
    assert all(a == b for a, b in rows.collect()) and [a for a, _ in rows.collect()][:2] == [3, 3]


def test_a_source_s_words_are_counted_in_its_row(spark):
    rows = spark.createDataFrame([("a", "Red fig", "red red apple"), ("b", "", "red"), ("c", "only", ""), ("d", "", "")], "path string, title string, content string")
    built = fts.build(fts.prepare_sources(rows.select("*", F.lit("document").alias("kind"), F.lit("policy").alias("authority"))))
    found = built.postings.join(built.sources.select("source_id", "path"), "source_id")
    assert sorted(tuple(r) for r in found.select("path", "term", "title_tf", "content_tf").collect()) == [
        ("a", "apple", 0, 1), ("a", "fig", 1, 0), ("a", "red", 1, 2), ("b", "red", 0, 1), ("c", "only", 1, 0),
    ]
    assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString()


def test_blocks_rank_their_sources_for_each_set_of_terms(spark, monkeypatch):
    monkeypatch.setattr(fts, "BLOCK", 7)
    contents = [" ".join(w for w, k in (("red", 1), ("fig", 2), ("pear", 3), ("plum", 5)) if n % k == 0) + " pad" * (n % 4) for n in range(40)]
    rows = spark.createDataFrame([(f"d{n:02}", "red" if n == 9 else "", c) for n, c in enumerate(contents)], "path string, title string, content string")
    index = fts.build(fts.prepare_sources(rows.select("*", F.lit("document").alias("kind"), F.lit("policy").alias("authority"))))
    queries = {"a": "red fig", "b": "fig RED", "c": "pear fig red", "d": "plum", "e": "red kiwi", "f": "pad red plum"}
    asked = spark.createDataFrame(list(queries.items()), "task_id string, query string")
    words = [(["red"] if n == 9 else [], c.split()) for n, c in enumerate(contents)]
    length = [8.0 * len(t) + len(c) for t, c in words]
    mean, want = sum(length) / len(length), []
    for task, q in queries.items():
        terms = sorted(q.lower().split())
        tf = {w: [8.0 * t.count(w) + c.count(w) for t, c in words] for w in terms}
        df = {w: sum(x > 0 for x in tf[w]) for w in terms}
        score = lambda n: round(sum(np.log1p((40 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w][n] * 2.2 / (tf[w][n] + 1.2 * (0.25 + 0.75 * length[n] / mean)) for w in terms), 6)  # noqa: E731, B023
        best = sorted((-score(n), f"d{n:02}") for n in range(40) if all(tf[w][n] for w in terms))
        want += [(task, p, k + 1, len(best) > 4, -s) for k, (s, p) in enumerate(best[:4])]
    got = fts.search_many(index, asked, limit=4).select("task_id", "path", "position", "limited", "score").collect()
    got = sorted(got, key=lambda r: (r["task_id"], r["position"]))
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want] and np.allclose([r["score"] for r in got], [w[4] for w in want], atol=2e-6)


def test_only_the_best_of_a_block_leave_it():
    posted = pd.DataFrame({"block": 0, "key": np.tile(np.arange(200), 2), "term_id": np.repeat([5, 6], 200), "weight": 2.0, "tf": 1.0})
    held = pd.DataFrame({"block": 0, "key": np.arange(200), "value": np.arange(200)[::-1] + 1, "norm": 1.0})
    asked = pd.DataFrame({"block": 0, "key": [1, 1, 2, 3], "value": [5, 6, 6, 7], "norm": -1.0})
    best = fts._ranked(posted, pd.concat([held, asked]), 3)
    assert list(zip(best["set_id"], best["key"], best["score"], strict=True)) == [(1, 199, 2.0), (1, 198, 2.0), (1, 197, 2.0), (2, 199, 1.0), (2, 198, 1.0), (2, 197, 1.0)]


def test_excerpts_are_cut_without_python(spark):
    values = ["é" * 9, "a\r\nb\rc\nd", "  x\x01y  ", "\n\n", "", None, "ab \u2003\x85é", "a𝒶𝒶", "\r\n" * 5, "abcdefgh   "]

    def want(value):
        clean = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", " ", value or "").strip(" ")
        head = "\n".join(re.split(r"\r\n|\n|\r", clean)[:3])
        return (head if len(head.encode()) <= 8 else head.encode()[:8].decode(errors="ignore").rstrip()) or text.EMPTY_EXCERPT

    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", text.bounded_excerpt(F.col("t"), 3, 8).alias("e"))
    assert [(r["t"], r["e"]) for r in rows.collect()] == [(v, want(v)) for v in values]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_an_excerpt_lies_around_the_first_line_with_a_term(spark):
    lines = [f"l{k}" for k in range(12)]
    long, end = "\r\n".join([*lines[:7], "ΣΑΣ Red", *lines[7:]]), "\n".join([*lines, "red"])
    rows = spark.createDataFrame([(long,), (end,), ("no",), ("\n".join(lines),), (None,)], "t string").select(text.relevant_excerpt(F.col("t"), F.array(F.lit("red"), F.lit("σας")), 3, 99).alias("e"))
    assert [r["e"] for r in rows.collect()] == ["l6\nΣΑΣ Red\nl7", "l11\nred", "no", "l0\nl1\nl2", text.EMPTY_EXCERPT]


def test_candidates_are_ranked_without_their_excerpts(spark, tmp_path):
    documents(spark, tmp_path, [(k, f"the other {k}") for k in range(9)])
    plan = candidates.aggregate(corpus.tasks(spark), [corpus.candidates(spark, str(tmp_path))], 2)
    assert plan.groupBy("task_id").count().where("count > 2").count() == 0 and plan.where("NOT truncated").count() == 0
    assert not re.search(r"Window[^\n]*\[task_id#\d+\]", plan._jdf.queryExecution().optimizedPlan().toString())  # the caps' order was found by keys before
    assert plan.where("excerpt = 'the other 8'").count() + plan.where("excerpt <> 'the other 8'").count() == 6
