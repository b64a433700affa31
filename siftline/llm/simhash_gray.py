"""SimHash near-duplicates found with a hierarchical index over Gray-ordered fingerprints.

Every text gets a 64-bit fingerprint from its word shingles. Equal fingerprints are one
node. Two fingerprints that differ in ``RADIUS`` bits or fewer agree wholly on at least
two of ``RADIUS + 2`` bit blocks, so each node is sent to one bucket per pair of blocks, and
every link shows up in some bucket. A pair of blocks has 20 bits or more, so buckets stay
small up to many billions of fingerprints. Inside a task the buckets' members are sorted by Gray rank
and grouped, level by level, under upper nodes that hold the bits all members share (a
mask and a pattern). Pairs of upper nodes are walked from the roots down; a pair is
dropped whole once its shared patterns differ in more bits than the radius, or once both
sides are known to be in one component. A bucket returns a spanning forest of its links,
never all pairs, and connected components over those links give the classes.

A bucket with more than ``HOT`` members is cut into chunks by a hash, and every pair of
chunks becomes a bucket of its own, so no task holds a whole hot bucket and no link is lost.

Defined results: null or wordless text has fingerprint zero and is linked like any other;
null ids count as greater than all others and stay null; repeated rows share a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .components import connected_components
from .rows import free_name, map_rows

SEED = 42
SHINGLE = 4
RADIUS = 4
FANOUT = 16
HOT = 20_000
FRONTIER = 1 << 20
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the text's word shingles in order; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of some hashes as a signed integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def wide_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of 64 * words bits (0 or 1) of some hashes: each word's bits are those of the hashes mixed with a number of its own."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, 64, dtype=np.uint64)[:words] | np.uint64(1)
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 240):  # a byte holds the sum
        x = hashes[at : at + 240, None] * odd
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles as a signed integer."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash (of the text, null too) and fp (signed 64-bit) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, lambda: lambda i, h, t: [(i, h, fingerprint(t, shingle))], "doc_id long, text_hash long, fp long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of radius + 2 blocks that make up the 64 bits."""
    cuts = [64 * k // (radius + 2) for k in range(radius + 3)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class GrayIndex:
    """Hierarchical index over the members of many buckets, and their self-join.

    bucket: each member's bucket; fp: its fingerprint; side: 0 where all members of the
    bucket meet each other, else 1 or 2 where only the two sides meet. Members are kept in
    (bucket, side, Gray rank) order. Level 0 groups are FANOUT consecutive members of one
    bucket and side; each further level groups FANOUT nodes until one node a side is left.
    more: further words of a wider fingerprint, which must differ in at most ``wide`` bits in
    all, those of fp included. order: which member each place holds.
    """

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, side: np.ndarray, more: tuple[np.ndarray, ...] = (), wide: int = 0) -> None:
        self.order = order = np.lexsort((gray_rank(fp), side, bucket))
        self.bucket, self.fp, self.side = bucket[order], fp[order], side[order]
        self.more, self.wide, self.edges = [m[order] for m in more], wide, []
        self.parent = np.arange(len(fp))
        part = np.r_[True, (self.bucket[1:] != self.bucket[:-1]) | (self.side[1:] != self.side[:-1])] if len(fp) else np.zeros(0, bool)
        self.levels = []  # of (first child, end, AND, OR, part)
        ands = ors = self.fp
        part = np.cumsum(part) - 1
        while len(part) and (not self.levels or len(part) > part[-1] + 1):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            at = np.arange(len(part)) - first[part]
            heads = np.flatnonzero(at % FANOUT == 0)
            ands, ors = np.bitwise_and.reduceat(ands, heads), np.bitwise_or.reduceat(ors, heads)
            ends = np.r_[heads[1:], len(part)]
            part = part[heads]
            self.levels.append((heads, ends, ands, ors, part))

    def _roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def _union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of each a and b; one pair for any two components is an edge."""
        root = self._roots()
        x, y = root[a], root[b]
        _, first = np.unique(np.minimum(x, y) * len(root) + np.maximum(x, y), return_index=True)
        first = first[x[first] != y[first]]
        a, b = a[first], b[first]
        self.edges.append((a, b))
        while len(a):
            root = self._roots()
            x, y = root[a], root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def _whole(self) -> list[np.ndarray]:
        """By level, the component that a node lies in as a whole, or -1."""
        low = high = self._roots()
        out = []
        for heads, _, _, _, _ in self.levels:
            low, high = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
            out.append(np.where(low == high, low, -1))
        return out

    def join(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fp, fp of its root) that connect what links within the buckets connect."""
        root = self.grow(radius)
        linked = root != np.arange(len(root))
        return self.fp[linked], self.fp[root[linked]]

    def close(self, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
        """Whether the members a and b differ in few enough bits."""
        apart = np.bitwise_count(self.fp[a] ^ self.fp[b]).astype(np.int64)
        near = apart <= radius
        if self.more:
            at = np.flatnonzero(near)
            near[at] = apart[at] + sum(np.bitwise_count(m[a[at]] ^ m[b[at]]).astype(np.int64) for m in self.more) <= self.wide
        return near

    def grow(self, radius: int) -> np.ndarray:
        """The root of each member: the first of those that links within its bucket connect with it. ``edges`` has links that connect them."""
        if not self.levels:
            return self.parent
        close = lambda a, b: self.close(a, b, radius)
        for step in (1, 2, 3):
            a = np.arange(len(self.fp) - step)
            a = a[self.bucket[a] == self.bucket[a + step]]
            a = a[(self.side[a] == 0) | (self.side[a] != self.side[a + step])]
            a = a[close(a, a + step)]
            self._union(a, a + step)
        top = len(self.levels) - 1
        part_side, part_bucket = self.side[self._first(top)], self.bucket[self._first(top)]
        own = np.flatnonzero(part_side == 0)
        one = np.flatnonzero((part_side[:-1] == 1) & (part_side[1:] == 2) & (part_bucket[:-1] == part_bucket[1:]))
        stack = [(top, np.r_[own, one], np.r_[own, one + 1])]
        whole, grown = self._whole(), 0
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER // FANOUT**2:  # FRONTIER pairs of children at most
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            _, _, ands, ors, _ = self.levels[level]
            same = whole[level]
            shared = ~(ands[a] ^ ors[a]) & ~(ands[b] ^ ors[b])
            alive = (np.bitwise_count((ands[a] ^ ands[b]) & shared) <= radius) & ((same[a] < 0) | (same[a] != same[b]))
            a, b = self._expand(level, a[alive], b[alive])
            if level:
                stack.append((level - 1, a, b))
                continue
            hit = close(a, b)
            if hit.any():
                self._union(a[hit], b[hit])
                grown += int(hit.sum())
                if grown > 4096:
                    whole, grown = self._whole(), 0
        return self._roots()

    def _first(self, level: int) -> np.ndarray:
        at = self.levels[level][0]
        for k in range(level - 1, -1, -1):
            at = self.levels[k][0][at]
        return at

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of the pairs of nodes, each unordered pair once."""
        heads, ends, *_ = self.levels[level]
        na, nb = ends[a] - heads[a], ends[b] - heads[b]
        count = na * nb
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        wide = np.repeat(nb, count)
        x, y = np.repeat(heads[a], count) + k // np.maximum(wide, 1), np.repeat(heads[b], count) + k % np.maximum(wide, 1)
        keep = (x <= y) if level else (x < y)
        return x[keep], y[keep]


def _joined(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    bucket, fp, side = (t.column(c).to_numpy() for c in ("bucket", "fp", "side"))
    a, b = GrayIndex(bucket, fp.view(np.uint64), side).join(radius)
    pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def dealt(placed: DataFrame, member: str, hot: int = HOT) -> DataFrame:
    """placed (bucket and more) with side; buckets of more than hot rows are cut into chunks by a hash of the member column, and every pair of chunks is a bucket."""
    crowded = placed.groupBy("bucket").count().where(F.col("count") > hot).select("bucket", F.ceil(F.col("count") / hot).cast("int").alias("chunks"))
    rest = [c for c in placed.columns if c != "bucket"]
    placed = placed.join(F.broadcast(crowded), "bucket", "left")  # a hot-th of the rows at most
    chunk = F.pmod(F.xxhash64(member, F.lit(7)), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    places = F.when(F.col("chunks").isNull(), F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            other,
            lambda c: F.struct(
                F.xxhash64("bucket", F.least(c, chunk), F.greatest(c, chunk)).alias("bucket"),
                F.when(c == chunk, 0).when(chunk < c, 1).otherwise(2).alias("side"),
            ),
        )
    )
    return placed.select(*rest, F.inline(places))


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Links a, b that connect the distinct fingerprints (column fp) within the radius as all links would."""
    bits = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << size) - 1)) for shift, size in blocks(radius)]
    keys = F.array(*[F.xxhash64(F.lit(k), a, b) for k, (a, b) in enumerate(itertools.combinations(bits, 2))])
    members = dealt(nodes.select("fp", F.explode(keys).alias("bucket")), "fp", hot).repartition("bucket").select("bucket", "fp", "side")
    return members.mapInArrow(lambda batches: _joined(batches, radius), "a long, b long")


def classes(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """prints (doc_id, fp and more) with class_fp, one fingerprint that stands for the class, and component, its least doc_id."""
    nodes = cut(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least")))
    roots = connected_components(links(nodes, radius, hot)).select(F.col("node").alias("n_fp"), "root")
    owned = nodes.join(roots, nodes["fp"] == roots["n_fp"], "left").select("fp", F.coalesce("root", "fp").alias("class_fp"), "least")
    named = owned.groupBy(F.col("class_fp").alias("r")).agg(F.min("least").alias("component"))
    member = owned.join(named, F.col("class_fp") == F.col("r")).select(F.col("fp").alias("m_fp"), "class_fp", F.nullif("component", F.lit(NO_ID)).alias("component"))
    return prints.join(member, prints["fp"] == member["m_fp"]).drop("m_fp")


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id for every row."""
    found = classes(cut(fingerprints(documents, shingle)), radius, hot)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """documents, all columns, with one row of each class: the least id, of its rows the least text hash."""
    return first_of_classes(documents, classes(cut(fingerprints(documents, shingle)), radius, hot))


def first_of_classes(documents: DataFrame, found: DataFrame) -> DataFrame:
    """documents with one row of each class_fp of found (doc_id, text_hash, class_fp): the least id, of its rows the least text hash."""
    own_id, own_hash = free_name("kept_id", documents), free_name("kept_hash", documents)
    best = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("h"))).alias("best")
    kept = found.groupBy("class_fp").agg(best).select(F.col("best.id").alias(own_id), F.col("best.h").alias(own_hash))
    same = (F.coalesce(documents["doc_id"], F.lit(NO_ID)) == kept[own_id]) & (F.xxhash64(documents["text"]) == kept[own_hash])
    return documents.join(kept, same).dropDuplicates([own_id, own_hash]).drop(own_id, own_hash)
