"""Chunked encoding against the tokenizer library on whole texts."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftline.llm import bpe_chunks, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    lines = open(P.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def texts():
    r = random.Random(8)
    alphabet = ["don't", "we'll", "they're", "'", "'v", " ", "  ", "\n", "\n\n ", "\t", "été", "語", "🙂", "1234", "…", "!!", "a", "word", " ", " ", "\x1c", "<|endoftext|>", "'re"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(300)]
    return [*made, "", None, "x" * 700, " " * 700, "a " * 500 + "b" * 300 + " c" * 500, "'" * 333, ("ll've" + " " * 50) * 20]


@pytest.mark.parametrize(("size", "overlap"), [(41, 12), (64, 33), (1 << 15, 1 << 10)])
def test_stitched_ids_are_those_of_the_whole_text(spark, library, size, overlap):
    rows = [(k, t, "s") for k, t in enumerate(texts())] + [(None, "null id " * 30, "s"), (5, "same id", "s"), (5, "same id", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = sorted((tuple(r) for r in bpe_chunks.report(docs, size=size, overlap=overlap).collect()), key=str)
    assert got == sorted((expected(library, i, t) for i, t, _ in rows), key=str)
    back = bpe_chunks.decode(bpe_chunks.encode(docs, size=size, overlap=overlap))
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)


def test_characters_that_the_engines_class_differently(library):
    use = bpe_chunks.Codec(bpe_chunks.VOCABULARY)
    assert use.unsure.search("\U000323b0") and not use.unsure.search("abc été 語 🙂")
    for c in [*sorted(use.plain)[::40], 0x558, 0x1C89, 0x323B0]:
        for text in (f"a{chr(c)}b", f"1{chr(c)}2", f" {chr(c)}!", f"été{chr(c)}{chr(c)} x"):
            assert use.ids(use.pieces(text)).tolist() == library.encode_ordinary(text) and "".join(use.pieces(text)) == text


def test_neighbours_without_a_shared_boundary(spark):
    docs = spark.createDataFrame([(1, "a" * 200), (2, "ab cd " * 40)], "doc_id long, text string")
    chunks = bpe_chunks.split_chunks(docs, bpe_chunks.VOCABULARY, 40, 10).cache()
    whole = {r["doc_id"]: r["whole"] for r in bpe_chunks.stitch(chunks).join(chunks.select("row", "doc_id"), "row").distinct().collect()}
    assert whole == {1: True, 2: False}


def test_given_table(spark, library):
    from siftline.sources.tables import table

    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.QUERIES["op12_bpe_chunks"](spark, SF).collect())
    assert got == sorted(expected(library, i, t) for i, t in docs)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_chunks.report(none).count() == 0 and bpe_chunks.encode(none).count() == 0
    assert bpe_chunks.decode(spark.range(1).select(F.lit(None).cast("array<int>").alias("ids"))).first()["decoded"] is None
    with pytest.raises(ValueError, match="overlap"):
        bpe_chunks.report(none, size=10, overlap=10)


def test_long_text(spark, library):
    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(3_000)]
    text = " ".join(r.choice(words) for _ in range(1_500_000))
    assert tuple(bpe_chunks.report(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()) == expected(library, 7, text)
