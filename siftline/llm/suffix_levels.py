"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts elsewhere, in
another document or in the same one. Not every suffix needs to be sorted. Of each window
of ``LENGTH`` bytes the smallest of its hashed ``GRAM``-byte strings is taken (the last, if
equal), so two equal windows always pick the same place. These places are the anchors,
about one in 85 bytes, and only suffixes that start at anchors are indexed, together with
the bytes to their left that a window can still reach.

1. Anchors leave the texts as hashes. Those whose gram occurs once cannot lie in a repeat.
2. The windows that picked one anchor are neighbours, and all they see are its surroundings.
   An anchor whose whole surroundings occur more than once is covered as far as it can be;
   nothing more has to be compared.
3. One representative of all other surroundings goes to the task of its gram, in order of
   grams. There every batch that arrives gets a suffix array, which is merge-scanned against
   the arrays of all existing levels for long matches, and becomes a level; levels of about
   equal size are merged, so sizes grow geometrically and each suffix is merged a
   logarithmic number of times (``SuffixLevels``). A task holds one batch and the suffixes
   of the gram it is at, never its partition. A scan compares bytes: neighbours in the order
   of the suffixes and in the order of the reversed prefixes say how far any two agree to
   the right and to the left, so the classes of equal windows at every distance from the
   anchor follow without pairs, in n log n for a gram of any crowd.
4. A gram with more than ``HOT`` different surroundings, such as a passage a third of all
   documents quote, is not held by one task: its windows are grouped as rows by a 128-bit
   hash, which are combined before the shuffle and give the same classes.

Equality of surroundings (step 2) rests on the 64-bit hash of the gram together with the
64-bit hash of the surroundings: only surroundings of one gram can be confused, with a
probability of k * k / 2**65 for k of them. All joins on them use both.

Defined results: null text is empty; texts shorter than LENGTH keep everything; repeated
rows are repeats of each other; ids may be null or repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, stored
from .rows import map_rows, share_join, worker_cache

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # a window that holds an anchor's gram starts at most so far to its left
HOT = 50_000  # different surroundings of one gram that one task still holds, about 20 MB
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 24


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    held = worker_cache()
    if "suffix_powers" not in held or len(held["suffix_powers"][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        held["suffix_powers"] = tuple(out)
    return held["suffix_powers"]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every gram-byte string of data."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=total[1:])
    z = (total[gram:] - total[:-gram]) * up[: len(data) - gram + 1]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(32)
    return z


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors, the hashes of the grams there, and the first and last window that each is the anchor of."""
    whole, found = np.frombuffer(data, np.uint8), []
    last = (1 << PLACE_BITS) - 1
    for at in range(0, len(data) - LENGTH + 1, CHUNK):
        v = gram_hashes(whole[at : at + CHUNK + LENGTH - 1])
        keys = v >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | (last - np.arange(len(v))).astype(np.uint64)
        span = REACH + 1
        rows = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        rows[: len(keys)] = keys
        rows = rows.reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keys) - span + 1
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        chosen = last - (least & np.uint64(last)).astype(np.int64)  # never decreases from window to window
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        place = chosen[first]
        found.append((place + at, v[place], first + at, np.r_[first[1:], n] - 1 + at))
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    place, gram, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # an anchor of windows in two chunks is one
    return place[heads], gram[heads], first[heads], end[np.r_[heads[1:], len(place)] - 1]


def _common(sorted_rows: np.ndarray) -> np.ndarray:
    """Leading bytes that each row has in common with the one before it; 0 for the first."""
    out = np.zeros(len(sorted_rows), np.int64)
    for at in range(1, len(sorted_rows), 1 << 14):
        differ = sorted_rows[at : at + (1 << 14)] != sorted_rows[at - 1 : at - 1 + len(sorted_rows[at : at + (1 << 14)])]
        out[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), differ.shape[1])
    return out


class SuffixLevels:
    """Sorted arrays of suffixes in levels of geometric size, with the long matches found so far.

    A suffix is a row of REACH bytes before its anchor and LENGTH bytes from it; left and
    right say how many of them there are. reach_left and reach_right hold, for every
    suffix, how far around its anchor repeated windows extend.
    """

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []  # of row numbers in suffix order
        self.size = 0
        self.rows = np.zeros((0, REACH + LENGTH), np.uint8)
        self.left = self.right = self.reach_left = self.reach_right = np.zeros(0, np.int64)

    def _keys(self, members: np.ndarray, size: int) -> np.ndarray:
        return np.ascontiguousarray(self.rows[members, REACH : REACH + size]).view(f"S{size}").ravel()

    def _take(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the new rows; room for them doubles."""
        first, self.size = self.size, self.size + len(rows)
        if self.size > len(self.rows):
            more = max(self.size, 2 * len(self.rows)) - len(self.rows)
            self.rows = np.concatenate([self.rows, np.zeros((more, self.rows.shape[1]), np.uint8)])
            self.left, self.right, self.reach_left, self.reach_right = (np.r_[x, np.zeros(more, np.int64)] for x in (self.left, self.right, self.reach_left, self.reach_right))
        self.rows[first : self.size], self.left[first : self.size], self.right[first : self.size] = rows, left, right
        return np.arange(first, self.size)

    def add(self, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """Sort a new batch, match it with itself and every level, and let it become a level."""
        new = self._sorted(self._take(rows, left, right))
        self._match(new)
        grams = np.unique(self._keys(new, GRAM))
        for level in self.levels:
            theirs = self._keys(level, GRAM)
            low, high = np.searchsorted(theirs, grams, "left"), np.searchsorted(theirs, grams, "right")
            met = np.repeat(low, high - low) + np.arange((high - low).sum()) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            if len(met):
                self._match(self._sorted(np.concatenate([level[met], new])))
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            self.levels.append(self._sorted(np.concatenate([self.levels.pop(-2), self.levels.pop()])))

    def _sorted(self, members: np.ndarray) -> np.ndarray:
        return members[np.argsort(self._keys(members, LENGTH), kind="stable")]

    def _match(self, order: np.ndarray) -> None:
        """Extend the reaches of some rows, given in suffix order, by the windows that two or more of them share.

        Two rows share the window that starts a bytes before the anchor if they agree in a
        bytes to the left and LENGTH - a to the right: if no neighbour between them in the
        order of the reversed left sides, or of the right sides, agrees in fewer.
        """
        if len(order) < 2:
            return
        right = _common(self.rows[order, REACH:])
        back = np.ascontiguousarray(self.rows[order, REACH - 1 :: -1])
        by_left = np.argsort(back.view(f"S{REACH}").ravel(), kind="stable")
        left = _common(back[by_left])
        most_right = np.minimum(np.maximum(right, np.r_[right[1:], 0]), self.right[order])
        most_left = np.zeros(len(order), np.int64)
        most_left[by_left] = np.maximum(left, np.r_[left[1:], 0])
        most_left = np.minimum(most_left, self.left[order])
        alive = np.flatnonzero(most_left + most_right >= LENGTH)
        if len(alive) < 2:
            return
        own_left, own_right = most_left[alive], most_right[alive]
        left_class = np.zeros(len(order), np.int64)
        for a in range(max(0, LENGTH - int(own_right.max())), int(own_left.max()) + 1):
            some = alive[(own_left >= a) & (own_right >= LENGTH - a)]
            if len(some) < 2:
                continue
            left_class[by_left] = np.cumsum(left < a)
            classes = np.cumsum(right < LENGTH - a)[some] * len(order) + left_class[some]
            _, where, count = np.unique(classes, return_inverse=True, return_counts=True)
            hit = order[some[count[where] > 1]]
            self.reach_left[hit] = np.maximum(self.reach_left[hit], a)
            self.reach_right[hit] = np.maximum(self.reach_right[hit], LENGTH - a)


def _anchor_rows(doc_id: int | None, text_hash: int, text: str | None) -> Iterator[tuple]:
    data = (text or "").encode()
    digest = xxhash.xxh3_64_intdigest
    place, gram, first, last = anchors(data)
    for p, g, a, b in zip(place.tolist(), gram.view(np.int64).tolist(), first.tolist(), last.tolist(), strict=True):
        around = digest(data[a : b + LENGTH], p - a)
        yield doc_id, text_hash, p, p - a, b + LENGTH - p, g, around - (1 << 64) if around >> 63 else around


ANCHORS = "doc_id long, text_hash long, place long, left int, right int, gram long, around long"


def _same(left: DataFrame, right: DataFrame, doc_id: str, text_hash: str) -> Column:
    return left["doc_id"].eqNullSafe(right[doc_id]) & (left["text_hash"] == right[text_hash])


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, around, hot, left, right, bytes of the wanted representatives (columns of ANCHORS and hot)."""
    own = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(F.collect_list(F.struct("place", "left", "right", "gram", "around", "hot")).alias("wanted"))

    def of(text: str | None, asked: list[dict]) -> Iterator[tuple]:
        data = (text or "").encode()
        for x in asked:
            p = x["place"]
            row = data[p - x["left"] : p + x["right"]]
            yield x["gram"], x["around"], x["hot"], x["left"], x["right"], row.rjust(len(row) + REACH - x["left"], b"\0").ljust(REACH + LENGTH, b"\0")

    joined = docs.join(own, _same(docs, own, "w_id", "w_hash")).select("text", "wanted")
    return map_rows(joined, lambda: of, "gram long, around long, hot boolean, left int, right int, bytes binary", 5_000)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reaches of the suffixes of one task, which come in order of their grams; only the gram that goes on is kept."""
    held: list[pa.RecordBatch] = []
    levels = SuffixLevels()

    def add(batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            rows = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8).reshape(len(batch), REACH + LENGTH)
            levels.add(rows, batch.column("left").to_numpy().astype(np.int64), batch.column("right").to_numpy().astype(np.int64))
            held.append(batch.select(["gram", "around"]))

    def found() -> pa.RecordBatch:
        names = pa.Table.from_batches(held).combine_chunks()
        hit = np.flatnonzero(levels.reach_right[: levels.size])
        columns = [names.column(c).to_numpy()[hit] for c in ("gram", "around")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, levels.reach_left[hit], levels.reach_right[hit])], names=["gram", "around", "to_left", "to_right"])

    for batch in batches:
        grams = batch.column("gram").to_numpy()
        last = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if len(grams) and grams[0] != grams[-1] else 0
        if last:
            add(batch.slice(0, last))
            yield found()
            held, levels = [], SuffixLevels()
        add(batch.slice(last))
    if held:
        yield found()


def _windows(gram: int, around: int, left: int, right: int, row: bytes) -> Iterator[tuple]:
    digest = xxhash.xxh3_128_digest
    for a in range(max(0, LENGTH - right), left + 1):
        yield gram, around, a, digest(row[REACH - a : REACH - a + LENGTH], gram + a & (1 << 64) - 1)


def covered(documents: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The documents as doc_id, text_hash, text; and per document (c_id, c_hash) the covered byte ranges, which may overlap."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = stored(map_rows(docs, lambda: _anchor_rows, ANCHORS), "anchors")
    twice = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    repeated = stored(share_join(found, twice, ["gram"], "n", "left_semi"), "repeated")
    release(found, twice)
    first = F.min(F.struct("doc_id", "text_hash", "place", "left", "right")).alias("first")
    kinds = stored(repeated.groupBy("gram", "around").agg(F.count("*").alias("n"), first), "kinds")
    several = stored(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("hot", F.col("kinds") > hot), "several")
    wanted = share_join(kinds, several, ["gram"], "kinds").select("gram", "around", "first.*", "hot")
    around = stored(_surroundings(docs, wanted), "surroundings")
    release(several)
    shape = "gram long, around long, to_left long, to_right long"
    reaches = around.where("NOT hot").repartition("gram").sortWithinPartitions("gram").drop("hot").mapInArrow(_indexed, shape)
    window = map_rows(around.where("hot").select("gram", "around", "left", "right", "bytes"), lambda: _windows, "gram long, around long, a int, window binary")
    shared = window.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
    hot_reaches = share_join(window, shared, ["window"], "n", "left_semi").groupBy("gram", "around").agg(F.max("a").cast("long").alias("to_left"), F.max(F.lit(LENGTH) - F.col("a")).cast("long").alias("to_right"))
    whole = kinds.where("n > 1").select("gram", "around", F.col("first.left").cast("long").alias("to_left"), F.col("first.right").cast("long").alias("to_right"))
    widest = whole.unionByName(reaches).unionByName(hot_reaches).groupBy("gram", "around").agg(F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right"))
    best = stored(widest.join(kinds.select("gram", "around", "n"), ["gram", "around"]), "reaches")
    release(around, kinds)
    reached = share_join(repeated, best, ["gram", "around"], "n")
    ranges = reached.select("doc_id", "text_hash", (F.col("place") - F.col("to_left")).alias("start"), (F.col("place") + F.col("to_right")).alias("end"))
    return docs, ranges.groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of some byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(documents: DataFrame, hot: int = HOT, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``kept`` also the removed runs and the kept bytes."""

    def of(doc_id: int | None, text: str | None, ranges: list[dict] | None) -> list[tuple]:
        data, runs = (text or "").encode(), merged(ranges)
        edges = [0, *(x for r in runs for x in r), len(data)]
        rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        more = ([{"start": a, "end": b} for a, b in runs], rest) if kept else ()
        return [(doc_id, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), *more)]

    docs, found = covered(documents, hot)
    joined = docs.join(found, _same(docs, found, "c_id", "c_hash"), "left").select("doc_id", "text", "ranges")
    more = ", removed array<struct<start:long,end:long>>, kept binary" if kept else ""
    return map_rows(joined, lambda: of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more, 5_000)
