"""Benchmark decontamination with a hash set of normalised test n-grams.

Main path is DataFrame expressions only. Each document's words are read once and cut into
blocks of ``BLOCK`` words, which overlap by a window less one word; each block is turned
into its windows of ``n`` consecutive words, so a text of any length has one block's
windows in memory at a time. The windows are looked up in the benchmark's window set by the
window string itself, so a hit is verified by equality and not only by its hash. The set
is broadcast while its measured size stays under ``broadcast_bytes``; beyond that the same
lookup runs as a shuffled join.

Defined results: null text or text without words gives no words and no hits; a benchmark
item without words has no window; an item shorter than ``n`` is one window of all its
words; repeated rows are each reported; null item ids are ignored in the item list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import bound, free_name, running

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NGRAM = 10
BROADCAST_BYTES = 64 << 20
BLOCK = 4_096


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def windows(tokens: Column, size: int, base: Column, most: int) -> Column:
    """Structs (at, n, gram) of the runs of ``size`` words that start at one of the first words; at counts from base + 1."""
    starts = F.when(F.size(tokens) >= size, F.sequence(F.lit(1), F.least(F.size(tokens) - (size - 1), F.lit(most))))
    return F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda i: F.struct((base + i).cast("int").alias("at"), F.lit(size).alias("n"), F.array_join(F.slice(tokens, i, size), " ").alias("gram"), F.lit(None).cast("int").alias("n_words")),
    )


def benchmark_windows(benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """One row per distinct window: gram, number of words, ids of the items that hold it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return (
        items.select("item", size.alias("gram_words"), F.explode(F.array_distinct(grams)).alias("gram"))
        .groupBy("gram", "gram_words")
        .agg(F.collect_set("item").alias("items"))
    )


def looked_up(documents: DataFrame, benchmark: DataFrame, keys: list[str], n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keys, at, n, items of every hit window, and a row with n_words (the others null) for every row of documents.

    documents has the ``keys`` columns and text. Windows are made and looked up where the
    text is read; only hits and the rows with n_words are left to shuffle.
    """
    grams = benchmark_windows(benchmark, n)
    size = grams.agg(
        F.coalesce(F.sum(F.octet_length("gram") + 64 + 32 * F.size("items")), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("gram_words")).alias("lengths"),
    ).first()
    known = grams.select(F.col("gram").alias("known"), "items")
    if size["bytes"] <= broadcast_bytes:
        known = F.broadcast(known)
    tokens = documents.select(*keys, words(F.col("text")).alias("w"))
    widest = max(size["lengths"], default=1)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / BLOCK), F.lit(0)).cast("int"))
    cuts = F.transform(starts, lambda b: F.struct((b * BLOCK).alias("base"), F.slice("w", b * BLOCK + 1, F.lit(BLOCK + widest - 1)).alias("part"), F.when(b == 0, F.size("w")).alias("whole")))
    parts = tokens.select(*keys, F.inline(cuts))
    row = F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("gram"), F.col("whole").alias("n_words"))
    first = F.when(F.col("whole").isNotNull(), F.array(row)).otherwise(F.slice(F.array(row), 1, 0))
    made = F.concat(first, *[windows(F.col("part"), k, F.col("base"), BLOCK) for k in size["lengths"]])
    return parts.select(*keys, F.inline(made)).join(known, F.col("gram") == F.col("known"), "left").where("gram IS NULL OR known IS NOT NULL").select(*keys, "at", "n", "items", "n_words")


def hits(documents: DataFrame, benchmark: DataFrame, keys: list[str], n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document key with a hit: the hit windows as distinct (at, n) structs."""
    return looked_up(documents, benchmark, keys, n, broadcast_bytes).where("at IS NOT NULL").groupBy(*keys).agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def covered(spans: Column) -> Column:
    """Number of word positions inside at least one of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["n"]
        fresh = F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))
        return F.struct((acc["count"] + fresh).cast("long").alias("count"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["count"])


def _keyed(documents: DataFrame) -> DataFrame:
    """A document's key is its id and the hash of its text: rows that share both have the same hits."""
    return documents.select(F.col("doc_id").alias("k_id"), F.xxhash64("text").alias("k_text"), "text")


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of documents."""
    rows = looked_up(_keyed(documents), benchmark, ["k_id", "k_text"], n, broadcast_bytes)
    spans = F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "n"))).alias("spans")
    found = rows.groupBy("k_id", "k_text").agg(F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"), spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    one = found.select("k_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return one.select(
        F.col("k_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, min_hit: int = NGRAM, n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents, all columns, without the rows of which ``min_hit`` or more words lie in hit windows.

    An item shorter than ``n`` words counts when it is hit whole, whatever ``min_hit`` says.
    """
    found = hits(_keyed(documents), benchmark, ["k_id", "k_text"], n, broadcast_bytes)
    bad = found.where((covered(F.col("spans")) >= min_hit) | F.exists("spans", lambda s: s["n"] < n)).select(F.col("k_id").alias("bad_id"), F.col("k_text").alias("bad_hash"))
    return documents.join(bad, documents["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(documents["text"]) == bad["bad_hash"]), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = NGRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """documents, all columns, with the words of hit windows cut out of the text.

    Text is rebuilt from its pieces: a hit word goes with the separator that follows it.
    Rows without a hit keep their text byte for byte.
    """
    own_id, own_hash, own_spans = (free_name(c, documents) for c in ("hit_id", "hit_hash", "hit_spans"))
    found = hits(_keyed(documents), benchmark, ["k_id", "k_text"], n, broadcast_bytes).select(F.col("k_id").alias(own_id), F.col("k_text").alias(own_hash), F.array_sort("spans").alias(own_spans))
    joined = documents.join(found, documents["doc_id"].eqNullSafe(found[own_id]) & (F.xxhash64(documents["text"]) == found[own_hash]), "left")
    any_case = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"{any_case}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    lead = F.regexp_extract(F.col("text"), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    ends = running(F.transform(own_spans, lambda s: s["at"] + s["n"]), lambda a, b: F.greatest(a, b), F.lit(0))  # of the words that are gone so far, exclusive

    def kept(x: Column) -> Column:
        gap = lambda s, i: F.slice(x["p"], F.when(i > 0, F.get(x["e"], i - 1)).otherwise(1), F.greatest(s["at"] - F.when(i > 0, F.get(x["e"], i - 1)).otherwise(1), F.lit(0)))
        between = F.flatten(F.transform(own_spans, gap))
        last = F.element_at(x["e"], -1)
        return F.concat(between, F.slice(x["p"], last, F.greatest(F.size(x["p"]) - last + 1, F.lit(0))))

    rest = bound(F.struct(pieces.alias("p"), ends.alias("e")), kept)
    return joined.withColumn("text", F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(rest, "")))).drop(own_id, own_hash, own_spans)
