"""Byte-level BPE encoding of texts of any length in overlapping chunks, and decoding.

A text is cut into chunks of ``CHUNK`` characters that read ``OVERLAP`` more; a text of one
chunk is encoded where it lies. The chunks of longer texts are dealt out, so one long text
is the work of many tasks:
1. Each chunk is split into pre-tokens from its own first character on, as if a pre-token
   began there. What a match can see ends with the character after it, so all matches that
   end before the chunk's last ``MARGIN`` characters are the same in the whole text.
2. Two neighbours have split the overlap both. From the first boundary that they share on,
   they split alike, for a match depends on what follows only. The text's pre-tokens are
   therefore those of each chunk from the boundary shared with the one before to the
   boundary shared with the next.
3. These pieces are encoded chunk by chunk, and the ids are read in order by one task a text
   that holds one chunk's ids at a time.
A text in which two neighbours share no boundary (a pre-token longer than the overlap) is put
together again and split in one go; nothing is cut.

Decoding concatenates the bytes of the ids.

Defined results: null text is empty and has no ids; ids of rows may be null or repeat, a row
is told from others by where it was read; an empty table gives no rows; other columns than
doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .packing import PLAIN, SPLIT
from .rows import map_rows, worker_cache

CHUNK, OVERLAP = 1 << 15, 1 << 10
MARGIN = 3  # the longest match that is chosen by what follows it: "'re"
VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED = 300_000


class Codec:
    """Ids of pre-tokens and bytes of ids of one public vocabulary; short pre-tokens are encoded once."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        lines = open(public_tokenizers.path(vocabulary), "rb").read().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = public_tokenizers.PATTERN
        self.split = regex.compile(self.pattern)
        self.core = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.bytes = [token for token, _ in sorted(ranks.items(), key=lambda pair: pair[1])]
        self.decimal = list(map(str, range(len(self.bytes))))
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """The matches of the vocabulary's pattern, each character in the class that the tokenizer library gives it.

        Texts of Latin letters and general punctuation have them from the standard library's
        engine, whose pattern names their classes' characters.
        """
        if PLAIN.match(text):
            return SPLIT.findall(text)
        if not self.unsure.search(text):
            return self.split.findall(text)
        at, out = 0, []
        for piece in self.split.findall(text.translate(self.plain)):
            out.append(text[at : at + len(piece)])
            at += len(piece)
        return out

    @cached_property
    def unsure(self) -> re.Pattern:
        """Characters newer than Python's tables: the splitting engines' tables may differ on them."""
        unknown = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
        starts = [c for c, before in zip(unknown, [-2, *unknown[:-1]], strict=True) if c != before + 1]
        ends = [c for c, after in zip(unknown, [*unknown[1:], -2], strict=True) if c + 1 != after]
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]")

    @cached_property
    def plain(self) -> dict[int, int]:
        """Such characters that ``split`` takes for letters or digits and the library does not, each with a stand-in that neither does.

        The library is asked: with a vocabulary in which each one forms a token with the
        letter or digit before it, it gives one token only if both are in one class.
        """
        import tiktoken

        out = {}
        for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
            taken = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and regex.match(kind, c)]
            ranks = {bytes([b]): b for b in range(256)}
            for c in taken:
                token = (lead + c).encode()
                for end in range(2, len(token) + 1):
                    ranks.setdefault(token[:end], len(ranks))
            ask = tiktoken.Encoding("ask", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            out |= {ord(c): 0x378 for c in taken if len(ask.encode_ordinary(lead + c)) > 1}
        return out

    def ids(self, pieces: list[str]) -> array:
        out, known = array("I"), self.known
        for piece in pieces:
            got = known.get(piece)
            if got is None:
                got = tuple(self.core.encode_single_piece(piece.encode()))
                if len(piece) < 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = got
            out.extend(got)
        return out

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec(vocabulary: str = VOCABULARY) -> Codec:
    held = worker_cache()
    if vocabulary not in held:
        held[vocabulary] = Codec(vocabulary)
    return held[vocabulary]


class _Digest:
    """Digests of a text's ids and of their bytes, fed in order."""

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def __init__(self, use: Codec) -> None:
        self.use, self.n, self.listed, self.decoded = use, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: array) -> None:
        if ids:
            self.listed.update((" " * (self.n > 0) + " ".join(map(self.use.decimal.__getitem__, ids))).encode())
            self.decoded.update(self.use.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple:
        return self.n, self.listed.hexdigest(), self.decoded.hexdigest()


class _Ids:
    """A text's ids themselves."""

    schema = "doc_id long, ids array<int>"

    def __init__(self, use: Codec) -> None:
        self.all = array("I")

    def add(self, ids: array) -> None:
        self.all.extend(ids)

    def row(self) -> tuple:
        return (self.all.tolist(),)


def _ends(use: Codec, text: str) -> array:
    out, at = array("I"), 0
    for piece in use.pieces(text):
        at += len(piece)
        out.append(at)
    return out


CHUNKS = "row long, doc_id long, chunk int, last boolean, text string, ends binary, head array<int>, tail array<int>"


def split_chunks(long_texts: DataFrame, vocabulary: str, size: int, overlap: int) -> DataFrame:
    """Chunks of (doc_id, text) with their pre-token boundaries: all, and those in the overlaps with the one before and the next.

    head and tail count from the overlap's first character.
    """

    def cut() -> Callable:
        rows = iter(range(TaskContext.get().partitionId() << 33, 1 << 62))

        def of(doc_id: int | None, text: str) -> Iterator[tuple]:
            row = next(rows)
            for k, at in enumerate(range(0, len(text), size)):
                yield row, doc_id, k, at + size >= len(text), text[at : at + size + overlap]

        return of

    def split() -> Callable:
        use = codec(vocabulary)

        def of(row: int, doc_id: int | None, k: int, last: bool, text: str) -> list[tuple]:
            ends = _ends(use, text)
            sure = len(text) - MARGIN
            head = [0, *(e for e in ends if e <= overlap)] if k else []
            tail = [] if last else [e - size for e in ends if size <= e < sure]
            return [(row, doc_id, k, last, text, ends.tobytes(), head, tail)]

        return of

    dealt = map_rows(long_texts, cut, "row long, doc_id long, chunk int, last boolean, text string", out_rows=64).repartition("row", "chunk")
    return map_rows(dealt, split, CHUNKS, out_rows=64)


def stitch(chunks: DataFrame) -> DataFrame:
    """row, chunk, begin, end of the pieces that each chunk gives (from its start; end null: to its end); whole: some neighbours share no boundary."""
    order = Window.partitionBy("row").orderBy("chunk")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    met = chunks.select("row", "chunk", "last", F.when(F.col("chunk") == 0, 0).otherwise(shared).alias("begin"))
    return met.select("row", "chunk", "begin", F.lead("begin").over(order).alias("next"), F.max(F.col("begin").isNull()).over(Window.partitionBy("row")).alias("whole"))


def _apply(documents: DataFrame, out: type, vocabulary: str, size: int, overlap: int) -> DataFrame:
    if size <= overlap or overlap <= MARGIN:
        raise ValueError("chunks must be longer than their overlap, and that longer than the margin")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def at_once() -> Callable:
        use = codec(vocabulary)

        def of(doc_id: int | None, text: str) -> list[tuple]:
            made = out(use)
            made.add(use.ids(use.pieces(text)))
            return [(doc_id, *made.row())]

        return of

    def encode() -> Callable:
        use = codec(vocabulary)

        def of(row: int, doc_id: int | None, k: int, text: str, ends: bytes, begin: int | None, after: int | None, whole: bool) -> list[tuple]:
            if whole:
                return [(row, doc_id, k, text[:size], None)]
            stop, at, pieces = len(text) if after is None else size + after, begin, []
            for e in array("I", ends):
                if begin < e <= stop:
                    pieces.append(text[at:e])
                    at = e
            return [(row, doc_id, k, None, use.ids(pieces).tobytes())]

        return of

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, now, made, held = codec(vocabulary), None, None, []

        def closed() -> pa.RecordBatch:
            if held:
                made.add(use.ids(use.pieces("".join(held))))
                held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, (now[1], *made.row()), strict=True))], schema=arrow)

        for batch in batches:
            for row, doc_id, _, text, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != row:
                    if now is not None:
                        yield closed()
                    now, made = (row, doc_id), out(use)
                if ids is None:
                    held.append(text)
                else:
                    made.add(array("I", ids))
        if now is not None:
            yield closed()

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in out.schema.split(", ")])
    names = arrow.names
    short = map_rows(texts.where(F.char_length("text") <= size), at_once, out.schema, out_rows=2_000)
    chunks = stored(split_chunks(texts.where(F.char_length("text") > size), vocabulary, size, overlap), "bpe_chunks")
    pieces = chunks.select("row", "doc_id", "chunk", "text", "ends").join(stitch(chunks), ["row", "chunk"]).select("row", "doc_id", "chunk", "text", "ends", "begin", "next", "whole")
    parts = map_rows(pieces, encode, "row long, doc_id long, chunk int, text string, ids binary", out_rows=64)
    long = parts.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(read, out.schema)
    return short.unionByName(long)


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids of every text."""
    return _apply(documents, _Ids, vocabulary, size, overlap)


def decode(encoded: DataFrame, column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids; null for null."""
    if "decoded" in (c.lower() for c in encoded.columns):
        raise ValueError("the table has a column decoded already")

    def text(ids: pa.Array) -> pa.Array:
        use = codec(vocabulary)
        return pa.array([None if x is None else use.decode(x) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", F.arrow_udf(text, "binary")(column))


def report(documents: DataFrame, vocabulary: str = VOCABULARY, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document the number of ids and digests of the ids and of the bytes they decode to."""
    return _apply(documents, _Digest, vocabulary, size, overlap)
