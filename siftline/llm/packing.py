"""Harmonic packing of token sequences.

A document's ids (its text's, then one 0) are cut into pieces. Class j holds pieces of
length capacity // j, so j of them fill a sequence but for less than j ids. A document
gives as many whole sequences (class 1) as it can, and its rest is cut, largest class
first, until SHORT or fewer ids are left, which go to the class of that length. Every
worker fills the sequences of each class on its own, with j pieces each, while it
tokenises. The pieces that fill no sequence of their worker, fewer than j a class and
worker, are numbered across workers with prefix counts and filled the same way; what is
left then is fewer than j pieces a class in all, a constant, and is packed first-fit
decreasing in one task.

Defined results: null text is empty text, which is the one id 0; repeated rows are packed
again; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .rows import worker_cache

CAPACITY = 1024
SHORT = 32
PART = 1 << 20
SPECIAL = "<|endoftext|>"  # fixed value: the tokenizer's one special token, an id of its own wherever it stands
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
CACHED_PIECES = 300_000
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t-\\r \\x85\\xa0"
#: Texts of these characters are split by SPLIT as the tokenizer would; others go through the tokenizer whole.
PLAIN = re.compile(r"[\x00-ſ‐-‧‰-⁞]*\Z")
#: A text may be cut before white space that follows a letter or digit: no piece of the tokenizer's pattern spans it.
SAFE = re.compile(r"(?<=[^\W_])(?=\s)")
SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class _Pieces(dict):
    """Little-endian ids of a split-off piece, computed once."""

    def __init__(self, encode: Callable[[bytes], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def public_tokenizer() -> Callable[[str], bytes]:
    """The 50k byte-level BPE: text to little-endian 32-bit ids. Equal to the tokenizer's own ids, special token included; the split pieces are cached."""
    held = worker_cache()
    if "packing" not in held:
        import public_tokenizers
        import tiktoken

        lines = open(public_tokenizers.path(RANKS), "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        held["packing"] = _Pieces(lambda b: core.encode_single_piece(b))
    pieces = held["packing"]

    def whole(text: str) -> bytes:
        if "packing_whole" not in held:
            import public_tokenizers
            from tokenizers import Tokenizer

            held["packing_whole"] = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
        return np.array(held["packing_whole"].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        return b"".join([pieces[p] for p in SPLIT.findall(text)]) if PLAIN.match(text) and SPECIAL not in text else whole(text)

    return lambda text: encode(text) if len(text) <= PART else b"".join(map(encode, parts(text)))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where the tokenizer's ids do not change; without such a place a part goes on."""
    at = 0
    while at < len(text):
        found = SAFE.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def cuts(tokens: int, capacity: int = CAPACITY, short: int = SHORT) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    at = 0
    while (left := tokens - at) > 0:
        j = max(1, -(-capacity // (left + 1)) if left < capacity else 1)
        while capacity // j > left:
            j += 1
        length = left if left <= short else capacity // j
        yield at, length
        at += length


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, worker long, class int, bin long, place long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pieces(documents: DataFrame, tokenizer: Callable[[], Callable[[str], bytes]] = public_tokenizer, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Pieces of all documents; bin and place are set for those that fill a sequence of their own worker.

    place counts a class's pieces in the bin, or in the worker's unfilled rest where bin is
    null. With ``ids`` the pieces carry their token ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = tokenizer(), TaskContext.get().partitionId()
        waiting: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        bins = 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = encode(text or "") + b"\0\0\0\0"
                view, total = memoryview(data), len(data) // 4
                for start, length in cuts(total, capacity):
                    j = capacity // length
                    own = view[4 * start : 4 * (start + length)]
                    held = waiting.setdefault(j, [])
                    held.append((doc_id, start, length, zlib.crc32(own), total, worker, j, *([np.frombuffer(own, "<i4").tolist()] if ids else [])))
                    if len(held) == j:
                        out.extend((*p[:7], bins, k, *p[7:]) for k, p in enumerate(held))
                        bins += 1
                        held.clear()
                if len(out) >= 20_000:
                    yield _batch(out, names)
                    out = []
        out.extend((*p[:7], None, k, *p[7:]) for held in waiting.values() for k, p in enumerate(held))
        if out:
            yield _batch(out, names)

    names = PIECES + (", ids array<int>" if ids else "")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, names)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _first_fit(left: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and offsets of the last pieces, first-fit decreasing."""
    left = left.sort_values(["length", "doc_id", "start", "worker", "place"], ascending=[False, True, True, True, True], ignore_index=True)
    room: list[int] = []
    bins, offsets = [], []
    for length in left["length"]:
        k = next((k for k, r in enumerate(room) if r >= length), len(room))
        if k == len(room):
            room.append(capacity)
        bins.append(k)
        offsets.append(capacity - room[k])
        room[k] -= length
    return left.assign(bin=pd.array(bins, "Int64"), offset=pd.array(offsets, "Int64"))


def pack(documents: DataFrame, tokenizer: Callable[[], Callable[[str], bytes]] = public_tokenizer, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece."""
    made = cut(pieces(documents, tokenizer, capacity, ids))
    more = ["ids"] if ids else []
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *more]
    span = 1 << 40  # sequence ids: worker's, then those filled across workers by class, then the last
    full = made.where("bin IS NOT NULL").withColumn("sequence_id", F.col("worker") * span + F.col("bin")).withColumn("offset", F.col("place") * F.col("length"))
    rest = made.where("bin IS NULL")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rest.groupBy("class", "worker").agg(F.count("*").alias("n"))
    starts = counts.select(F.col("class").alias("c"), F.col("worker").alias("w"), before.alias("base"), F.sum("n").over(Window.partitionBy("class")).alias("total"))
    numbered = rest.join(starts, (F.col("class") == F.col("c")) & (F.col("worker") == F.col("w"))).withColumn("k", F.col("base") + F.col("place")).drop("c", "w")
    filled = F.col("k") < F.col("total") - F.col("total") % F.col("class")
    across = (
        numbered.where(filled)
        .withColumn("sequence_id", -(F.col("class") * F.lit(span) + F.floor(F.col("k") / F.col("class"))))
        .withColumn("offset", F.col("k") % F.col("class") * F.col("length"))
    )
    last = numbered.where(~filled).select(*NAMES, *more).withColumn("offset", F.lit(None).cast("long"))
    tail = last.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(lambda left: _first_fit(left.drop(columns="whole"), capacity), last.schema).withColumn("sequence_id", -F.col("bin") - 1)
    return full.select(*out).unionByName(across.select(*out)).unionByName(tail.select(*out))
